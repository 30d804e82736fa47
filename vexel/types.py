"""Metrics, element types, index kinds, and which combinations are legal."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Metric(str, Enum):
    L2 = "l2"
    IP = "ip"
    COSINE = "cosine"
    HAMMING = "hamming"
    JACCARD = "jaccard"

    @classmethod
    def parse(cls, name: str | Metric) -> Metric:
        name = getattr(name, "value", name).strip().lower()
        return cls({"euclidean": "l2", "inner_product": "ip", "dot": "ip", "cos": "cosine", "cosine_similarity": "cosine"}.get(name, name))


class DType(str, Enum):
    BINARY = "binary"
    FLOAT = "float"
    FLOAT16 = "float16"
    BFLOAT16 = "bfloat16"
    SPARSE = "sparse_float"
    INT8 = "int8"


_FLOATS = {DType.FLOAT, DType.FLOAT16, DType.BFLOAT16}
_DENSE = {Metric.L2, Metric.IP, Metric.COSINE}
#: Kind of index: the element types and metrics it takes.
LEGAL: dict[str, tuple[set[DType], set[Metric]]] = (
    {k: ({DType.BINARY}, {Metric.HAMMING}) for k in ("bin_flat", "bin_ivf_flat", "bin_hnsw", "minhash_lsh")}
    | {k: (_FLOATS, _DENSE) for k in ("flat", "ivf_flat", "ivf_flat_cc", "ivf_pq", "scann", "ivf_sq8", "ivf_sq_cc", "ivf_turboquant", "rhtsdg", "diskann", "aisaq")}
    | {"ivf_usq": (_FLOATS, {Metric.L2})}
    | {k: (_FLOATS | {DType.INT8}, _DENSE) for k in ("hnsw", "hnsw_sq", "hnsw_pq", "hnsw_prq")}
    | {k: ({DType.SPARSE}, {Metric.IP}) for k in ("sparse_inverted", "sparse_inverted_cc", "sparse_wand", "sparse_wand_cc")}
)
#: Kinds that are other names of the same operator here: tables are immutable, so concurrent variants need no other code.
ALIASES = {"ivfflat": "ivf_flat", "ivf": "ivf_flat", "ivfpq": "ivf_pq", "ivfsq8": "ivf_sq8", "binflat": "bin_flat", "brute_force": "flat", "ivf_rabitq": "ivf_usq", "vamana": "diskann"}


def kind_of(name: str) -> str:
    name = name.strip().lower().replace("-", "_")
    name = ALIASES.get(name, name)
    if name not in LEGAL:
        raise ValueError(f"unknown index kind {name!r}")
    return name


def is_legal(kind: str, dtype: DType | str, metric: Metric | str) -> bool:
    try:
        kind, dtype, metric = kind_of(kind), DType(dtype), Metric.parse(metric)
    except ValueError:
        return False
    if kind == "hnsw" and dtype is DType.BINARY:
        return metric is Metric.HAMMING
    return dtype in LEGAL[kind][0] and metric in LEGAL[kind][1]


@dataclass(frozen=True)
class IndexConfig:
    """What an index is and how it is searched."""

    kind: str
    dim: int
    metric: Metric = Metric.L2
    dtype: DType = DType.FLOAT
    nlist: int = 100
    nprobe: int = 8
    m: int = 8
    nbits: int = 8
    degree: int = 16
    ef: int = 64
    rerank: int = 4
    seed: int = 42
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "kind", kind_of(self.kind))
        object.__setattr__(self, "metric", Metric.parse(self.metric))
        object.__setattr__(self, "dtype", DType(self.dtype))
        if self.dim <= 0:
            raise ValueError("dim must be positive")
        if not is_legal(self.kind, self.dtype, self.metric):
            raise ValueError(f"{self.kind} doesn't take {self.dtype.value} with {self.metric.value}")


def adaptive_ef(base: int, k: int, override: int = 0, adaptive_k: float = 2.0) -> int:
    """Beam width of a search: at least base, an override above 1, and adaptive_k times k."""
    return max(base, override if override > 1 else 0, int(adaptive_k * k))
