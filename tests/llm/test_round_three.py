"""Hard negatives, spelling variants and language identification against plain Python, edge cases included."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import integers as I  # noqa: E741
from tidemark.llm import op11_hard_negatives as op11
from tidemark.llm import op12_spelling as op12
from tidemark.llm import op13_language_id as op13
from tidemark.session import ship

VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.fixture(scope="module", autouse=True)
def package_on_workers(spark):
    ship(spark)


# Hard negatives


def plain_negatives(rows):
    fine = [(i, e, k) for i, e, k in rows if i is not None and e is not None and k is not None and all(x is not None and math.isfinite(x) for x in e)]
    rows = [(i, [math.floor(256 * x) if abs(x) < 2**53 else int(x) * 256 for x in e], (k + 1) % 10 if i % 7 == 0 else k) for i, e, k in fine]
    out = []
    for i, v, k in rows:
        if i % 50 == 0:
            score = lambda w: sum(a * b for a, b in zip(v, w))  # noqa: B023, E731
            mine = [(-score(w), j) for j, w, m in rows if len(w) == len(v) and m == k and j != i]
            others = [(-score(w), j) for j, w, m in rows if len(w) == len(v) and m != k]
            for p, pid in sorted(mine)[:5]:
                window = sorted(s for s in others if -50 * p <= -100 * s[0] <= -95 * p)
                out += [(i, pid, n + 1, j, -p, -s) for n, (s, j) in enumerate(window[:3])]
    return sorted(out)


def negatives(spark, rows, **sizes):
    frame = op11.relabelled(spark.createDataFrame(rows, VECTORS))
    found = op11.hard_negatives(frame, lambda i: i % 50 == 0, **sizes)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(n, dims, seed, labels=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (8, dims))
    return [(i, [float(x) for x in centers[rng.integers(8)] + rng.normal(0, 0.2, dims)], int(rng.integers(labels))) for i in range(n)]


def test_op11_equals_plain_search_with_many_blocks_and_cells(spark):
    rows = clustered(900, 6, 1)
    want = plain_negatives(rows)
    assert len(want) > 100
    assert negatives(spark, rows) == want
    assert negatives(spark, rows, block_rows=40, pack_rows=3) == want


def test_op11_special_rows(spark):
    rows = clustered(120, 3, 2, labels=2)
    rows += [(50, [0.5, 0.5, 0.1], 0), (50, [0.5, 0.5, 0.1], 0), (51, [0.5, 0.5, 0.1], 1)]  # repeated ids and rows
    rows += [(200, None, 1), (250, [0.1, None, 0.2], 1), (300, [0.1, float("nan"), 0.2], 0), (350, [float("inf"), 0.0, 0.0], 0), (400, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(450, [], 0), (451, [], 0), (452, [], 1), (500, [1.0, 2.0], 0), (501, [1.0, 2.0], 0), (502, [1.0, 1.0], 1)]  # empty, other length
    rows += [(550, [0.0, 0.0, 0.0], 1)]
    assert negatives(spark, rows, block_rows=25, pack_rows=2) == plain_negatives(rows)
    assert negatives(spark, []) == []


def test_op11_wide_components_are_exact(spark):
    rows = clustered(100, 2, 3, labels=2)
    rows += [(1000, [3e6, 1.0], 0), (1002, [2e6, 5.0], 0), (1004, [1.8e6, 5.0], 1), (1003, [1e17, -1e17], 1), (1005, [1e300, -1e300], 2)]
    want = plain_negatives(rows)
    assert any(abs(r[4]) > 2**53 for r in want)
    assert negatives(spark, rows) == want


def test_op11_returned_score_beyond_64_bits_is_an_error(spark):
    rows = [(0, [1e300], 1), (1, [1e300], 2), (2, [0.9e300], 1), (3, [0.7e300], 3)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        negatives(spark, rows)


def test_op11_repeated_vector_with_most_rows(spark):
    rows = [(i, [0.25, 0.5], i % 2) for i in range(300)] + clustered(100, 2, 4, labels=2)
    rows = [(n, e, k) for n, (_, e, k) in enumerate(rows)]
    assert negatives(spark, rows, block_rows=30) == plain_negatives(rows)


def test_op11_prunes_whole_anchor_groups(spark):
    rng = np.random.default_rng(5)

    def frame(lo, label, n):
        return pd.DataFrame({"dims": 2, "wide": False, "grp": 0, "id": np.arange(n) + 1, "label": label, "x": list(rng.normal(lo, 0.05, (n, 2))), "rid": np.arange(n), "windows": ["[[60000, 70000]]"] * n})

    pack = op11.Pack(op11.block_of(op11.ANCHOR_LEAF)(frame(1.0, 0, 200)).iloc[0].to_dict(), 3)
    far = op11.Side(op11.block_of(op11.LEAF)(frame(-1.0, 1, 2000).drop(columns="rid")).iloc[0].to_dict())
    pack.score = None  # would fail if any pair of leaves were scored
    pack.meet(far, False)


def test_op11_order_of_large_scores():
    numbers = [0, 1, -1, 2**63 - 1, 2**63, -(2**63), -(2**63) - 1, 10**40, -(10**40), 10**40 + 1, -(10**40) - 1, 9 * 10**39]
    assert sorted(numbers, key=I.stored) == sorted(numbers)
    assert [I.loaded(*I.stored(n)) for n in numbers] == numbers


def test_op11_other_columns_do_not_clash(spark):
    rows = clustered(120, 3, 6)
    frame = spark.createDataFrame(rows, VECTORS)
    for c in ("id", "x", "dims", "wide", "grp", "rid", "cell", "number", "pack", "salt", "j", "score"):
        frame = frame.withColumn(c, F.lit("other"))
    found = op11.hard_negatives(frame, lambda i: i % 50 == 0)
    plain = op11.hard_negatives(spark.createDataFrame(rows, VECTORS), lambda i: i % 50 == 0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


# Spelling variants


def plain_groups(rows):
    counts = collections.Counter()
    upper = str.maketrans(op12.UPPER, op12.LOWER)
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(upper)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def one_apart(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        a, b = sorted((a, b), key=len)
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]

    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] else None for w in words}
    form = {w: f if f and words[f] >= 10 * words[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def groups(spark, rows):
    out = op12.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return [tuple(r) for r in out.collect()]


def misspelt(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(7, 10))) for _ in range(25)]
    text = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at, what = rng.randrange(len(w)), rng.choice("idr")
            w[at : at + (what != "i")] = [] if what == "d" else [rng.choice("abcé")]
        text.append("".join(w))
    return text


def test_op12_equals_plain_groups(spark):
    words = misspelt(1, 4000)
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(100)]
    got, want = groups(spark, rows), plain_groups(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[4] > 0 for r in want) > 100


def test_op12_chains_of_forms_end_in_one_root(spark):
    chain = ["aaaaaaaz", "aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb"]
    rows = [(1, " ".join(w for k, w in enumerate(chain[1:]) for _ in range(2 * 12**k)))]
    got = groups(spark, rows)
    assert set(got) == plain_groups(rows)
    assert {r[2] for r in got} == {"aaaaabbb"} and any(r[1] != r[2] and r[1] for r in got)


def test_op12_special_rows(spark):
    rows = [(1, None), (2, ""), (None, "Repeated Repeated repeateD"), (3, "ÉTONNANT étonnant Étonnant"), (4, "short short words"), (4, "short short words"), (5, "x" * 50000 + " " + "x" * 50000), (6, "x" * 49999 + "y " + "x" * 49999 + "y"), (7, "multi×ply multi×ply ÿÿÿÿÿÿÿ ÿÿÿÿÿÿÿ")]
    got = groups(spark, rows)
    assert set(got) == plain_groups(rows) and len(got) == len(set(got))
    assert groups(spark, [(1, "no word twice here")]) == []
    assert op12.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    more = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("word", "n", "key", "short", "near", "form", "root", "run"):
        more = more.withColumn(c, F.lit("other"))
    assert sorted(map(tuple, op12.spelling_groups(more).collect()), key=str) == sorted(got, key=str)


def test_op12_slips_delete_the_stated_letter(spark):
    rows = [(i, "wonderful") for i in range(200)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", op12.slipped(F.col("doc_id"), F.col("text")).alias("w")).collect()
    for r in got:
        h = zlib.crc32(f"{r['doc_id']}:wonderful".encode())
        assert r["w"] == ("wonderful"[: h % 9] + "wonderful"[h % 9 + 1 :] if h % 31 == 0 else "wonderful")
    assert any(len(r["w"]) == 8 for r in got)


@pytest.mark.parametrize("a,b", [("abababab", "babababa"), ("aaaaaaa", "aaaaaaaa"), ("abcdefg", "abcdefgh"), ("abcdefg", "zabcdefg"), ("abcdefg", "abczefg"), ("abcdefgh", "abcdfgh")])
def test_op12_words_one_apart_share_a_key(a, b):
    def apart(x, y):
        return len(x) - len(y) in (-1, 0, 1) and any(y == v for v in {x[:i] + c + x[j:] for i in range(len(x) + 1) for j in (i, i + 1) for c in ("", *"abcdefghz")})

    grams = sorted({w[i : i + 2] for w in (a, b) for i in range(len(w) - 1)})
    for seed in range(5):
        random.Random(seed).shuffle(grams)
        order = {g: i for i, g in enumerate(grams)}
        assert not apart(a, b) or op12.join_keys(a, order) & op12.join_keys(b, order)


# Language identification

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


def spoken(seed, n, mixed=True):
    rng = random.Random(seed)
    syllables = {"aa": ["the", "ing", "tion", "of", "and"], "bb": ["der", "sch", "ung", "ich", "ü"], "cc": ["que", "eau", "é", "les", "ou"]}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        out.append((i, " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang))
    return out


def test_op13_counts_equal_plain_counts():
    texts = ["Abc, déf 12 GHI", "", "  a  ", "日本語 text", "x" * 50, "a b c\n\nd"]
    column = pa.array(texts)
    got = np.concatenate([c for _, _, c in op13.parts(column)])

    def place(gram):
        code = int.from_bytes(gram, "big")
        return ((code * 0x9E3779B1 + (0x85EBCA6B if len(gram) == 2 else 0)) % 2**32) >> 19

    for row, t in zip(got, texts):
        data = bytes(op13.LOWER[np.frombuffer(t.encode(), np.uint8)]) if t else b""
        plain = re.sub(b" +", b" ", b" " + data + b" ")
        want = collections.Counter(place(plain[i : i + k]) for k in (2, 3) for i in range(len(plain) - k + 1))
        assert {i: int(n) for i, n in enumerate(row) if n} == want


def test_op13_long_texts_are_read_whole(monkeypatch):
    text = " ".join(t for _, t, _ in spoken(3, 60))
    whole = [c for _, _, c in op13.parts(pa.array([text]))][0]
    monkeypatch.setattr(op13, "WINDOW", 97)
    assert (np.concatenate([c for _, _, c in op13.parts(pa.array([text]))]) == whole).all()
    assert (np.concatenate([c for _, _, c in op13.parts(pa.array([text, "short"]))])[0] == whole[0]).all()


def test_op13_held_out_accuracy_and_contract(spark):
    rows = spoken(1, 600)
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, "the ing of", None), (None, "der schung", "bb"), (5, rows[5][1], rows[5][2]), (1004, "é", "cc")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("bucket", "df", "center", "held_out", "score", "lettered", "source"):
        docs = docs.withColumn(c, F.lit("other"))
    got = [tuple(r) for r in op13.languages(docs, reject=False).collect()]
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows}
    plain = [r for r in got if r[0] is not None and r[0] < 600]
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in plain)
    assert np.mean([r[2] == truth[r[0]] for r in plain if r[1]]) > 0.97
    assert all(0 <= r[3] <= 1 for r in got)
    by_id = {r[0]: r for r in got}
    assert {by_id[i][2] for i in (1000, 1001, 1002)} == {"und"} and {by_id[i][3] for i in (1000, 1001, 1002)} == {0.0}
    assert by_id[1003][2] == "aa" and by_id[None][2] == "bb" and by_id[None][1] is True


def test_op13_learns_nothing_from_held_out_rows(spark):
    rows = spoken(2, 200)
    changed = [(i, t if zlib.crc32(str(i).encode()) % 5 else t, lang if zlib.crc32(str(i).encode()) % 5 else "zz") for i, t, lang in rows]
    a = sorted(map(tuple, op13.languages(spark.createDataFrame(rows, SCHEMA), reject=False).collect()))
    b = sorted(map(tuple, op13.languages(spark.createDataFrame(changed, SCHEMA).repartition(3), reject=False).collect()))
    assert [(r[0], r[2], round(r[3], 5)) for r in a] == [(r[0], r[2], round(r[3], 5)) for r in b]


def test_op13_rejects_texts_far_from_every_centroid(spark):
    rows = spoken(4, 300) + [(9000 + i, "щжйъ эюыя " * 20, None) for i in range(3)]
    got = {r["doc_id"]: r for r in op13.languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[9000 + i]["rejected"] and got[9000 + i]["lang_pred"] == "und" for i in range(3))
    assert np.mean([got[i]["rejected"] for i in range(300)]) < 0.1


def test_op13_without_anything_to_learn(spark):
    got = op13.languages(spark.createDataFrame([(1, "some text", None), (None, "more", "aa")], SCHEMA)).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in got} == {("und", 0.0, False)}
    assert op13.languages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op13_sample_is_bounded_with_a_hot_text(spark):
    rows = [(i, "the same text", "aa") for i in range(2000)] + [(3000 + i, f"text number {i}", "aa") for i in range(1000)] + [(9000, "other", "bb")]
    drawn = op13.sample(spark.createDataFrame(rows, SCHEMA).select("lang", "text"), 50).collect()
    counts = collections.Counter(r["lang"] for r in drawn)
    assert counts["aa"] == 50 and counts["bb"] == 1 and len({r["text"] for r in drawn}) == 51


# Substring dedup: hot cells


def test_op2_a_passage_in_a_third_of_the_rows_is_one_lookup_a_batch():
    from tidemark.llm import op2_substring_dedup as op2

    anchors = [[5, 9] if i % 3 else [5, 100 + i] for i in range(200)] + [[], [7]]
    batch = pa.record_batch([pa.array(range(202), pa.int64()), pa.array(range(1000, 1202), pa.int64()), pa.array(anchors, pa.list_(pa.int64()))], ["row", "doc", "anchors"])
    (out,) = op2.lookups(1 << 16)(iter([batch]))
    rows = out.to_pylist()
    assert len(rows) == len({a for x in anchors for a in x})
    held = sorted(len(r["more"]) if r["more"] else 1 for r in rows)
    assert held[-1] == 200 and held[-2] == 133 and held[0] == 1
    pairs = {(m["row"], m["doc"]) for r in rows for m in (r["more"] or [r])}
    assert pairs == {(i, 1000 + i) for i, x in enumerate(anchors) if x}


def test_op1_rows_of_large_nodes_are_joined_once_and_grow_with_the_group(spark, monkeypatch):
    from tidemark.llm import op1_jaccard_join as op1

    rng, written = random.Random(3), []
    keep = op1.materialise
    monkeypatch.setattr(op1, "materialise", lambda df, name, **k: written.append((name, df._jdf.queryExecution().optimizedPlan().toString(), out := keep(df, name, **k))) or out)
    shed = []
    for m in (150, 300):  # a group of one node, none of it near another
        written.clear()
        reps = spark.createDataFrame([(i, [1, 2], bytes(rng.randrange(256) for _ in range(op1.TOKENS))) for i in range(m)], "rid long, paths array<long>, sketch binary")
        op1.candidate_stars(reps, levels=2, small=16).count()
        joins = [line for name, plan, _ in written if re.fullmatch(r"held\d*|shed0", name) for line in plan.splitlines() if re.search(r"Join Inner,.*\(node#\d+L? = node#\d+L?\)", line)]
        assert sum("xxhash64" not in j for j in joins) == 1  # the pivots' join; the draw's join puts out the drawn rows alone
        shed.append(next(t.count() for name, _, t in written if name == "shed0"))
    assert shed[0] <= shed[1] <= 2.2 * shed[0]
