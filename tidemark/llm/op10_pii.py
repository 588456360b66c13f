"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Candidates come from patterns: the four base kinds (email, ip, card, phone), and wider ones: account (long digit chains
that are no base card, international bank account numbers; a chain of more than ``LONGEST`` digits is split into its
numbers, and those that are valid cards are candidates of kind card), contact (spelt-out addresses, telephone numbers
without a plus) and secret (values after token, key, password and the like, and keys of published formats). Five labelers
vote 1, 0 or -1 on each: the kind's strict shape, a gazetteer (top-level domains, country codes, card issuers' ranges,
reserved networks, secret names and key formats), context words before the span, its boundaries, and the variety of its
digits. Votes are summed up into a table of vote patterns, a few hundred rows whatever the input; on it
expectation-maximisation estimates each labeler's reliability and each pattern's probability, and a logistic span
classifier is trained on kind, votes and length against these probabilities. The classifier adds spans of the wider kinds
and of cards inside longer chains at ``CUT`` or more; spans of the base rules always stay. Jobs run while the result is
being built: candidates are written, and their vote patterns counted.

All text work is built-in expressions: a pattern splits the text, and a span starts where the pieces before it end.
Patterns are possessive or bounded and look behind, so a long run of matching characters is scanned once; running sums
go by blocks, so a text with very many spans takes little more than linear time. Positions are code points, ends
exclusive. Null and empty texts have no spans; repeated rows are treated alike; of wide candidates that touch, secret
goes before account number, contact and chain; an empty table gives an empty result; no candidates, no classifier.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table

# The base patterns in possessive form, and what makes a match of them valid.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBERS = r"(?<![0-9-])(?:[0-9]-?){8,23}[0-9](?![0-9-])|[0-9]++"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# The wider patterns and the labelers' lists.
CONTACT = (
    r"(?<![A-Za-z0-9+])(?:"
    r"[A-Za-z0-9._-]{1,40} ?(?i:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,40}(?: ?(?i:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z]{2,10})+|"
    r"[A-Za-z0-9._-]{1,40} (?i:at) [A-Za-z0-9-]{1,40}(?: (?i:dot) (?i:com|org|net|edu|gov|info|[a-z]{2})(?![A-Za-z]))+|"
    r"\([0-9]{2,5}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[.-][0-9]{4})(?![0-9])"
)
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
KEYS = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{30,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)"
NAMED = r"(?i:token|secret|passw(?:or[dt])?|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential)s?[\"']?[ ]?(?:[=:]>?)[ ]?[\"']?"
SECRET = NAMED + r"[^\s\"'<>,;]{7,}[^\s\"'<>,;.:)!?\]*#$%&]|(?<![A-Za-z0-9])" + KEYS
BOOK = r"^97[89][0-9-]{10,14}$"
TLDS = r"\.(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|io|ai|app|dev|[A-Za-z]{2})$"
NO_HOSTS = r"(?i)\.(?:invalid|test|local|localhost)$"
RESERVED_NETS = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[345][0-9])\."
ISSUERS = r"^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[68]|35(?:2[89]|[3-8])|6011|62|64[4-9]|65)"
COUNTRIES = r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-8])"
CUES = r"(?:mail|contact|reach|write|phone|tel|mobile|call|fax|address|host|server|card|visa|account|konto|iban|ssn|passport|token|secret|password|user|name)"
AGAINST = r"(?:version|release|isbn|issn|doi|section|figure|table|page|chapter|order|invoice|article|item|serial)\W*(?:no\.?|number|#)?\W*$"

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "contact", "secret")
KINDS = BASE + ADDED
LABELERS = ("shape", "gazetteer", "context", "boundary", "variety")
CUT = 0.5
AROUND = 24
LONGEST = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before_each(lengths: Column) -> Column:
    """Sums of the elements before each, in blocks of about the square root of their number: an array is copied to append to it."""
    running = lambda a: F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def build(a: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(1), F.size(a), step), lambda i: running(F.slice(a, i, step)))
        return let(blocks, lambda b: let(running(F.transform(b, lambda x: F.element_at(x, -1))), lambda base: F.flatten(F.transform(b, lambda x, k: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: y + F.get(base, k))))))

    return let(lengths, build)


def matches(text: Column, pattern: str, may: Column) -> Column:
    """array of (at, word, before, after) of all leftmost matches; ``may`` is a cheap condition without which there is none."""
    none = F.array().cast("array<struct<at:bigint,word:string,before:string,after:string>>")

    def build(z: Column) -> Column:
        n = F.size(z["words"])
        lengths = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.length(F.get(z["pieces"], i)) + F.length(F.get(z["words"], i))).cast("long"))
        spans = let(
            before_each(lengths),
            lambda e: F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.struct((F.get(e, i) + F.length(F.get(z["pieces"], i))).alias("at"), F.get(z["words"], i).alias("word"), F.right(F.get(z["pieces"], i), F.lit(AROUND)).alias("before"), F.left(F.get(z["pieces"], i + 1), F.lit(1)).alias("after")),
            ),
        )
        return F.when(n > 0, spans).otherwise(none)

    found = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("words"))
    return F.when(may, let(found, build)).otherwise(none)


def digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, double).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def is_card(word: Column) -> Column:
    return let(digits(word), lambda d: F.length(d).between(16, 19) & luhn(d))


def is_ip(word: Column) -> Column:
    return F.rlike(word, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))


def is_phone(word: Column) -> Column:
    return F.length(digits(word)).between(8, 15)


def vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return out.when(no, -1).otherwise(0) if no is not None else out.otherwise(0)


def span(kind: str, s: Column) -> Column:
    """A candidate with its votes."""
    word = s["word"]
    lead = F.length(F.regexp_extract(word, rf"^{NAMED}", 0)) if kind == "secret" else F.lit(0)
    value = F.substr(word, lead + 1) if kind == "secret" else word
    number = digits(word)
    shape = {
        "email": vote(F.rlike(word, F.lit(r"\.[A-Za-z]{2,24}$")), F.lit(True)),
        "ip": F.lit(1),
        "card": F.lit(1),
        "phone": vote(F.length(number).between(10, 13), F.length(number) < 9),
        "account": vote((F.length(number).between(12, 19) & ~F.rlike(word, F.lit(BOOK))) | F.rlike(word, F.lit(r"^[A-Z]{2}[0-9]{2}|^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), F.rlike(word, F.lit(BOOK)) | (F.length(number) > 19)),
        "contact": F.lit(1),
        "secret": vote((F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))) | F.rlike(word, F.lit("PRIVATE KEY")), F.lit(True)),
    }[kind]
    gazetteer = {
        "email": vote(F.rlike(word, F.lit(TLDS)), F.rlike(word, F.lit(NO_HOSTS))),
        "ip": vote(~F.rlike(word, F.lit(RESERVED_NETS)), F.lit(True)),
        "card": vote(F.rlike(word, F.lit(ISSUERS)), F.lit(True)),
        "phone": vote(F.rlike(word, F.lit(COUNTRIES))),
        "account": vote(F.length(number).between(16, 19) & F.rlike(word, F.lit(ISSUERS)), F.length(number) < 12),
        "contact": F.lit(0),
        "secret": vote(F.rlike(word, F.lit(rf"^(?:{KEYS}|(?i:token|secret|passw|api|access|private))"))),
    }[kind]
    context = vote(F.lit(True) if kind == "secret" else F.rlike(F.lower(s["before"]), F.lit(CUES)), F.rlike(F.lower(s["before"]), F.lit(AGAINST)))
    edge = F.rlike(F.right(s["before"], F.lit(1)), F.lit(r"[\p{L}0-9]")) | F.rlike(s["after"], F.lit(r"[\p{L}0-9]"))
    several = F.size(F.array_distinct(F.split(number, "")))
    variety = vote(several >= 5, (F.length(number) >= 8) & (several <= 2))
    start = s["at"] + lead
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        start.alias("start"),
        (s["at"] + F.length(word)).alias("end"),
        F.array(shape, gazetteer, context, vote(~edge, F.lit(True)), variety).alias("votes"),
        F.least(F.lit(4), F.floor(F.length(word) / 8)).cast("int").alias("size"),
    )


def inside_any(s: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"]))


def numbers(chain: Column) -> Column:
    """The numbers of a chain of more than ``LONGEST`` digits, split at its blanks and hyphens.

    A group of nine or more digits is a number of its own (so is a hyphened one of up to 24 between blanks). Of shorter
    groups, neighbours that form a valid card are one number; the others are joined up to 19 digits, and a rest of fewer
    than nine goes to the number before it.
    """
    none = F.array().cast("array<struct<a:int,b:int,n:int,open:boolean>>")

    def part(a: Column, b: Column, n: Column, still: bool) -> Column:
        return F.array(F.struct(a.alias("a"), b.alias("b"), n.alias("n"), F.lit(still).alias("open")))

    def build(groups: Column) -> Column:
        n = F.size(groups)
        length = lambda i: F.length(digits(F.get(groups, i)["word"]))

        def card_end(i: Column) -> Column:
            """The last group of the shortest valid card of short groups from ``i`` on, or null."""
            ends = F.when(i + 1 < n, F.sequence(i + 1, F.least(i + 18, n - 1))).otherwise(F.array().cast("array<int>"))
            valid = lambda j: let(F.slice(groups, i + 1, j - i + 1), lambda g: F.forall(g, lambda x: F.length(digits(x["word"])) < 9) & is_card(F.array_join(F.transform(g, lambda x: x["word"]), "")))
            return F.get(F.filter(ends, valid), F.lit(0))

        def step(acc: Column, i: Column) -> Column:
            last, size = F.get(acc, F.size(acc) - 1), length(i)
            joins = last["open"] & (last["n"] + size <= 19)
            longer = F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), part(last["a"], i, last["n"] + size, True))
            short = let(card_end(i), lambda j: F.when(j.isNotNull(), F.concat(acc, part(i, j, F.lit(16), False))).when(joins, longer).otherwise(F.concat(acc, part(i, i, size, True))))
            return F.when(i <= last["b"], acc).when(size >= 9, F.concat(acc, part(i, i, size, False))).otherwise(short)

        def spans(parts: Column) -> Column:
            tail = lambda p, q: p["open"] & q["open"] & (q["n"] < 9)
            whole = F.transform(parts, lambda p, k: F.struct(p["a"].alias("a"), F.when(tail(p, F.get(parts, k + 1)), F.get(parts, k + 1)["b"]).otherwise(p["b"]).alias("b"), p["n"].alias("n")))
            return F.transform(F.filter(whole, lambda p: p["n"] >= 9), lambda p: cut(F.get(groups, p["a"]), F.get(groups, p["b"]), p["a"] == 0, p["b"] == n - 1))

        def cut(first: Column, last: Column, at_start: Column, at_end: Column) -> Column:
            """The words before the chain stand before each of its numbers."""
            word = F.substring(chain["word"], (first["at"] + 1).cast("int"), (last["at"] + F.length(last["word"]) - first["at"]).cast("int"))
            before = F.when(at_start, chain["before"]).otherwise(F.concat(chain["before"], F.lit(" ")))
            after = F.when(at_end, chain["after"]).otherwise(F.lit(" "))
            return F.struct((chain["at"] + first["at"]).alias("at"), word.alias("word"), before.alias("before"), after.alias("after"))

        return let(F.aggregate(F.sequence(F.lit(0), n - 1), none, step), spans)

    return let(matches(chain["word"], NUMBERS, F.lit(True)), build)


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, base: array of base spans, wide: array of other candidates (cards of longer chains too) that touch no base span and no earlier candidate kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = F.rlike(text, F.lit("[0-9][0-9 .()-]{6,}[0-9]"))
    raw = docs.select(
        "doc_id",
        matches(text, EMAIL, F.contains(text, F.lit("@"))).alias("email"),
        matches(text, IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]+\.[0-9]"))).alias("ip"),
        matches(text, CARD, digit).alias("chain"),
        matches(text, PHONE, F.contains(text, F.lit("+")) & F.rlike(text, F.lit(r"\+[0-9]"))).alias("phone"),
        matches(text, CONTACT, digit | F.rlike(text, F.lit(r"(?i)[\[({]at[\])}]|\([0-9]{2,5}\) ?[0-9]|[a-z0-9] at [a-z0-9-]+ dot [a-z]"))).alias("contact"),
        matches(text, SECRET, F.rlike(text, F.lit(rf"{NAMED}|{KEYS}"))).alias("secret"),
        matches(text, IBAN, F.rlike(text, F.lit("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"))).alias("iban"),
    )
    # Written out and read back: the spans are few, and are not matched again for the second use.
    raw = materialise(raw, "matches")
    kept = lambda c, ok: F.filter(c, lambda s: ok(s["word"]))
    base = F.concat(
        F.transform("email", lambda s: span("email", s)),
        F.transform(kept("ip", is_ip), lambda s: span("ip", s)),
        F.transform(kept("chain", is_card), lambda s: span("card", s)),
        F.transform(kept("phone", is_phone), lambda s: span("phone", s)),
    )
    chains = F.filter("chain", lambda s: (F.length(digits(s["word"])) >= 9) & ~is_card(s["word"]))
    chains = F.flatten(F.transform(chains, lambda s: F.when(F.length(digits(s["word"])) > LONGEST, numbers(s)).otherwise(F.array(s))))
    wide = raw.withColumn("base", base).withColumn("contact", F.filter(F.transform("contact", lambda s: span("contact", s)), lambda s: ~inside_any(s, F.col("base"))))
    wide = wide.withColumn("secret", F.filter(F.transform("secret", lambda s: span("secret", s)), lambda s: ~inside_any(s, F.col("base"))))
    wide = wide.withColumn("iban", F.filter(F.transform("iban", lambda s: span("account", s)), lambda s: ~inside_any(s, F.col("base")) & ~inside_any(s, F.col("secret"))))
    wide = wide.withColumn("contact", F.filter("contact", lambda s: ~inside_any(s, F.col("iban")) & ~inside_any(s, F.col("secret"))))
    taken = F.concat("base", "contact", "secret", "iban")
    wide = wide.withColumn("account", let(taken, lambda t: F.filter(F.transform(chains, lambda s: F.when(is_card(s["word"]), span("card", s)).otherwise(span("account", s))), lambda s: ~inside_any(s, t))))
    return wide.select("doc_id", "base", F.concat("iban", "account", "contact", "secret").alias("wide"))


def expectation_maximisation(table_: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list[list[list[float]]], dict[tuple[int, ...], float]]:
    """Labelers' reliabilities, P(vote | class) of those that vote (0 abstains and says nothing), and each vote pattern's probability of being personal data."""
    total = sum(n for _, n in table_)
    post = {v: 1 / (1 + math.exp(-sum(v))) for v, _ in table_}
    rates: list[list[list[float]]] = []
    for _ in range(rounds):
        good = sum(n * post[v] for v, n in table_)
        prior = (good + 1) / (total + 2)
        rates = []
        for j in range(len(LABELERS)):
            seen = [{-1: 2.0, 1: 1.0}, {-1: 1.0, 1: 2.0}]  # a labeler is believed to be better than chance
            for v, n in table_:
                if v[j]:
                    seen[1][v[j]] += n * post[v]
                    seen[0][v[j]] += n * (1 - post[v])
            rates.append([[side[-1] / sum(side.values()), 1.0, side[1] / sum(side.values())] for side in seen])
        for v, _ in table_:
            log = math.log(prior / (1 - prior)) + sum(math.log(rates[j][1][x + 1] / rates[j][0][x + 1]) for j, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return rates, post


def features(kind: int, votes: tuple[int, ...], size: int) -> list[str]:
    return ["bias", f"kind{kind}", f"size{size}", *[f"vote{j}:{x}" for j, x in enumerate(votes) if x]]


def train(rows: list[tuple[list[str], float, int]], steps: int = 300) -> dict[str, float]:
    """Logistic weights by gradient descent on soft labels, rows weighted by their counts."""
    total = float(sum(n for *_, n in rows))
    weights = {f: 0.0 for fs, *_ in rows for f in fs}
    for _ in range(steps):
        slope = {f: 1e-4 * w for f, w in weights.items()}
        for fs, target, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in fs)))))
            for f in fs:
                slope[f] += (p - target) * n / total
        for f, g in slope.items():
            weights[f] -= 2.0 * g
    return weights


def classifier(spans: DataFrame) -> tuple[dict[str, float], list[list[list[float]]]]:
    """Weights and reliabilities from all candidates; what reaches the driver is the table of distinct patterns, bounded by kinds x sizes x 3^labelers."""
    seen = spans.select(F.explode(F.concat("base", "wide")).alias("s")).groupBy("s.kind", "s.votes", "s.size").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = sorted((r["kind"], tuple(r["votes"]), r["size"], r["n"]) for r in seen)
    if not seen:
        return {}, []
    by_votes: dict[tuple[int, ...], int] = {}
    for _, v, _, n in seen:
        by_votes[v] = by_votes.get(v, 0) + n
    rates, post = expectation_maximisation(sorted(by_votes.items()))
    return train([(features(k, v, s), post[v], n) for k, v, s, n in seen]), rates


def probability(s: Column, weights: dict[str, float]) -> Column:
    def pick(value: Column, names: dict[int, str]) -> Column:
        out = F.lit(0.0)
        for x, name in names.items():
            out = F.when(value == x, weights.get(name, 0.0)).otherwise(out)
        return out

    total = F.lit(weights.get("bias", 0.0)) + pick(s["kind"], {k: f"kind{k}" for k in range(len(KINDS))}) + pick(s["size"], {k: f"size{k}" for k in range(5)})
    for j in range(len(LABELERS)):
        total = total + pick(F.get(s["votes"], F.lit(j)), {x: f"vote{j}:{x}" for x in (-1, 1)})
    return 1 / (1 + F.exp(-total))


def text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, base and added: arrays of (kind number, start, end, votes, size)."""
    spans = materialise(extract(docs), "spans")
    weights, _ = classifier(spans)
    return spans.select("doc_id", "base", F.filter("wide", lambda s: probability(s, weights) >= cut).alias("added"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the columns asked for: how many spans the method adds, and whether there are any spans."""
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    added = F.size("added").cast("long")
    return found.select("doc_id", *counts, F.sha2(text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"), text_of(F.concat("base", "added")).alias("spans"), added.alias("n_added"), (F.size("base") + added > 0).alias("has_pii"))
