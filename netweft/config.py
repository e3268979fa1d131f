"""Defaults and choices of meaning."""
from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Semantics:
    """Where the model's definition leaves a choice. literal_rescale: multinomial values outside [0, 1] become 1000 or 1001
    instead of 1 to 1001. mask_missing: the denominators of metadata rates count nodes with data only. literal_floor: logs
    of non-positive fields take the smallest positive one of the system instead of ``tol``."""

    literal_rescale: bool = False
    mask_missing: bool = False
    literal_floor: bool = False
    keep_self_loops: bool = False


@dataclass(frozen=True)
class Settings:
    """Of inference; budgets are small because each sweep is a Spark job."""

    max_iter: int = 30
    max_msg_iter: int = 10
    conv_tol: float = 1e-5
    msg_conv_tol: float = 1e-5
    tol: float = 1e-50
    learning_rate: float = 0.2
    planted_p: float = 0.6
    n_runs: int = 5
    at_once: int = 4  # fits that run side by side; each keeps its own messages in the shared folder
    fe_freq: int = 3
    patience: int | None = None
    tuning: float = 1.0
    auto_tune: bool = False
    alpha_use_all: bool = True  # else of rows where a node begins
    informative: bool = False  # parameters begin near those of the initial labels
    init_meta: bool = False  # k-means takes metadata too
    init_width: int = 64  # columns that k-means hashes neighbours to
    h_q: int = 8
    h_min_n: int = 20
    max_cats: int = 20


def load_settings(path: str | Path, base: Settings = Settings()) -> Settings:
    """Settings from lines ``name: value``, # begins a comment. ``non_informative_init`` is the opposite of ``informative``; names
    of switches that this engine has no use for (update order, degree threshold, fast math) are passed over, others refused."""
    kinds, found = {f.name: type(getattr(base, f.name)) for f in fields(Settings)}, {}
    for line in Path(path).read_text().splitlines():
        name, colon, value = (x.strip() for x in line.split("#", 1)[0].partition(":"))
        if not name or name in ("large_deg_thr", "random_online_update_msg", "use_fastmath"):
            continue
        if not colon or name not in (*kinds, "non_informative_init"):
            raise ValueError(f"no such setting: {line.strip()}")
        flag = value.lower() in ("true", "yes", "on", "1")
        if name == "non_informative_init":
            found["informative"] = not flag
        elif name == "patience":
            found[name] = None if value.lower() in ("", "none", "null", "~") else int(value)
        else:
            found[name] = flag if kinds[name] is bool else kinds[name](value)
    return replace(base, **found)
