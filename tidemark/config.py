"""Settings of the analyses: fixed defaults, overridable from a YAML file."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class Tier:
    name: str
    label: str
    start: str
    end: str
    group_by: str
    sample_per_group: int


# The defaults every analysis is stated with.
TIERS = (
    Tier("T1_fine", "2023-2026", "2023-06", "2026-05", "month", 400),
    Tier("T2_medium", "2020-2023", "2020-06", "2023-05", "month", 400),
    Tier("T3_coarse", "2016-2020", "2016-06", "2020-05", "year", 1500),
    Tier("T4_historic", "1998-2016", "1998-06", "2016-05", "year", 5000),
)
ERAS = (("2016-2019", "2016-06-01", "2019-12-31"), ("2020-2022", "2020-01-01", "2022-12-31"), ("2023-2026", "2023-01-01", "2026-05-31"))
UMBRELLA_TERMS = (
    "llm", "llms", "transformer", "transformers", "deep learning", "neural network", "neural networks", "attention",
    "attention mechanism", "large language model", "language model", "language models", "machine learning", "deep neural",
    "deep neural network", "foundation model", "foundation models", "pretrained", "pre-trained", "fine-tuned", "finetuned",
    "gpt", "bert",
)
BURST_TERMS = (
    "deep learning", "neural network", "transformer", "attention", "reinforcement learning", "gan", "bert", "gpt", "llm",
    "large language model", "diffusion", "graph neural", "federated learning", "contrastive learning", "self-supervised",
    "vision transformer", "stable diffusion", "chatgpt", "agent", "rag", "retrieval augmented", "prompt",
    "chain of thought", "rlhf", "lora", "quantization",
)
PARADIGMS = {
    "Neural Network": ("neural network", "neural networks", "deep learning", "deep neural"),
    "SVM": ("support vector", "svm", "kernel method"),
    "Graphical Model": ("graphical model", "bayesian network", "markov random"),
    "Deep Learning": ("deep learning", "deep neural", "cnn", "convolutional neural"),
    "Reinforcement Learning": ("reinforcement learning", "deep reinforcement", "dqn", "policy gradient"),
    "GAN": ("gan", "generative adversarial", "adversarial network"),
    "Transformer": ("transformer", "self-attention", "attention mechanism"),
    "BERT": ("bert", "pretrained language", "fine-tun"),
    "Graph Neural Network": ("graph neural", "gnn", "graph convolution", "message passing"),
    "Diffusion": ("diffusion model", "denoising diffusion", "ddpm", "score-based"),
    "LLM": ("large language model", "llm", "gpt", "language model"),
}


@dataclass(frozen=True)
class Settings:
    """One field for each setting; ``load`` reads the same tree from YAML."""

    categories: tuple[str, ...] = ("cs.AI", "cs.CL", "cs.LG", "cs.CV")
    start_date: str = "1998-06-01"
    end_date: str = "2026-05-31"
    random_seed: int = 42
    sample_per_group: int = 400
    tiers: tuple[Tier, ...] = TIERS
    eras: tuple[tuple[str, str, str], ...] = ERAS
    early: tuple[int, int] = (2000, 2010)
    late: tuple[int, int] = (2020, 2025)
    umbrella_terms: tuple[str, ...] = UMBRELLA_TERMS
    k_values: tuple[int, ...] = (20, 50, 100, 200)
    top_n_keywords: int = 50
    granger_lags: int = 4
    fdr_alpha: float = 0.05
    burst_terms: tuple[str, ...] = BURST_TERMS
    burst_sigma: float = 2.0
    burst_min_months: int = 3
    paradigms: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(PARADIGMS))
    first_appearance: float = 0.001
    pelt_penalty: float = 3.0
    pelt_jump: int = 3
    pelt_min_size: int = 6
    sensitivity_penalties: tuple[float, ...] = (1, 2, 3, 5, 10)
    control_pre: tuple[str, str] = ("2018-01", "2022-10")
    control_post: tuple[str, str] = ("2022-11", "2026-05")
    pair_category: str = "cs.CV"
    pair_years: tuple[int, ...] = (2019, 2020, 2021, 2022, 2023, 2024, 2025)
    pair_months: tuple[str, str, str] = ("02", "03", "04")
    min_topic_size: int = 30
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int = 2


def from_tree(tree: dict[str, Any]) -> Settings:
    """Settings from a nested mapping; what it lacks keeps its default."""
    get = lambda *path: _walk(tree, path)
    found: dict[str, Any] = {f.name: tree[f.name] for f in fields(Settings) if f.name in tree and f.name not in ("tiers", "eras", "paradigms")}
    if tiers := get("tiers"):
        found["tiers"] = tuple(Tier(k, t["label"], t["start"][:7], t["end"][:7], t["group_by"], int(t["sample_per_group"])) for k, t in tiers.items())
    named = {
        "eras": ("eras", "cv_eras"), "early": ("eras", "early"), "late": ("eras", "late"),
        "umbrella_terms": ("jaccard", "umbrella_terms"), "k_values": ("jaccard", "k_values"), "top_n_keywords": ("jaccard", "top_n_keywords"),
        "granger_lags": ("granger", "max_lag"), "fdr_alpha": ("granger", "fdr_alpha"),
        "burst_terms": ("burst", "target_terms"), "burst_sigma": ("burst", "sigma_threshold"), "burst_min_months": ("burst", "min_duration_months"),
        "first_appearance": ("first_appearance_threshold",), "pelt_penalty": ("pelt", "penalty"), "pelt_jump": ("pelt", "jump"),
        "pelt_min_size": ("pelt", "min_size"), "sensitivity_penalties": ("pelt", "sensitivity_penalties"),
        "control_pre": ("synthetic_control", "pre_period"), "control_post": ("synthetic_control", "post_period"),
        "pair_category": ("cvpr", "treatment_category"), "pair_years": ("cvpr", "years"),
    }
    for name, path in named.items():
        if (value := get(*path)) is not None:
            found[name] = value
    if paradigms := get("paradigms"):
        found["paradigms"] = {k: tuple(p["terms"]) for k, p in paradigms.items()}
    for name in ("control_pre", "control_post"):
        if name in found:
            found[name] = tuple(x[:7] for x in found[name])
    return Settings(**{k: _frozen(v) for k, v in found.items()})


def load(path: str | None = None) -> Settings:
    """Settings from a YAML file, or the defaults."""
    if path is None:
        return Settings()
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_tree(yaml.safe_load(f) or {})


def _walk(tree: Any, path: tuple[str, ...]) -> Any:
    for key in path:
        if not isinstance(tree, dict) or key not in tree:
            return None
        tree = tree[key]
    return tree


def _frozen(value: Any) -> Any:
    return tuple(_frozen(v) for v in value) if isinstance(value, list) else value
