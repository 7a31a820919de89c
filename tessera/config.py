"""Settings of the engine.

Everything that changes a result is a field here, so a job can state it once and
the ingest fingerprint can include it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Rule order, keywords, whitelists and sizes are part of the result.
SOURCE_RULES = (
    (("accommodation",), "accommodation"),
    (("course", "ug_"), "courses"),
    (("sport",), "sports"),
    (("offer", "faq", "entry"), "admissions"),
)
TEXT_RULES = (
    (("ensuite", "self_catered", "launderette", "tenancy_weeks", "hall"), "accommodation"),
    (("ucas", "entry requirements", "modules", "course", "undergraduate"), "courses"),
    (("sport", "athletic", "club", "gym"), "sports"),
    (("contextual offer", "offer", "admissions", "application"), "admissions"),
)
ENTITY_MARKERS = ("name", "title", "course", "question", "hall", "sport")
PRICE_MARKERS = ("per_week_gbp", "total_contract_gbp", "fees")
PRICE_LINE_MARKERS = ("per_week_gbp", "fees")
ENTRY_MARKERS = ("entry requirements", "ucas")
LOCATION_MARKERS = (".address", "campus")
NAME_LINE_MARKER = ".name:"
DOMAINS = ("accommodation", "courses", "sports", "admissions", "finance", "general", "unknown")
SECTIONS = (
    "prices",
    "entry_requirements",
    "modules",
    "fees",
    "funding",
    "facilities",
    "contact",
    "overview",
    "qna",
    "json_fields",
    "text",
)
UNKNOWN_DOMAIN = "unknown"
MAX_TAGS = 12
MAX_PRICE_LINES = 3
HEURISTIC_CONFIDENCE = 0.35
MODEL_CONFIDENCE = 0.6
TOP_K_RANGE = (1, 50)
CHANNEL_K_RANGE = (1, 250)
DEFAULT_TOP_K = 8


@dataclass(frozen=True)
class ChunkRules:
    """How a source becomes chunks."""

    json_lines: int = 30
    text_lines: int = 40
    separator: str = "---"
    id_prefix: int = 120

    def __post_init__(self):
        if min(self.json_lines, self.text_lines, self.id_prefix) < 1:
            raise ValueError("chunk sizes must be positive")


@dataclass(frozen=True)
class DomainRules:
    """Ordered keyword rules; the first that matches names the domain."""

    source: tuple = SOURCE_RULES
    text: tuple = TEXT_RULES


@dataclass(frozen=True)
class IngestConfig:
    """One ingest run; its fingerprint decides whether stored chunks are still valid."""

    version: str = "v1"
    embedder_backend: str = "hash"
    embedder_name: str = "deterministic-hash-64"
    embedding_dim: int = 64
    tagger_mode: str = "heuristic"
    tagger_name: str = "heuristic"
    chunks: ChunkRules = field(default_factory=ChunkRules)
    rules: DomainRules = field(default_factory=DomainRules)

    def signature(self) -> dict:
        return {
            "version": self.version,
            "embedder_backend": self.embedder_backend,
            "embedder_name": self.embedder_name,
            "tagger_mode": self.tagger_mode,
            "tagger_name": self.tagger_name,
            "json_group_size": self.chunks.json_lines,
        }


@dataclass(frozen=True)
class FusionWeights:
    """Weights of the fused score; channel weights are rescaled to sum to one."""

    vector: float = 0.55
    text: float = 0.45
    overlap: float = 0.20
    section: float = 0.15
    tag: float = 0.10
    tag_cap: int = 2
    rank_share: float = 0.7

    def __post_init__(self):
        if self.vector < 0 or self.text < 0:
            raise ValueError("channel weights must not be negative")
        if self.vector + self.text == 0:
            raise ValueError("one channel weight must be positive")

    def normalised(self) -> "FusionWeights":
        total = self.vector + self.text
        return replace(self, vector=self.vector / total, text=self.text / total)


@dataclass(frozen=True)
class SearchConfig:
    """How a batch of queries is answered."""

    weights: FusionWeights = field(default_factory=FusionWeights)
    vector_mode: str = "exact"
    text_mode: str = "bm25_then_scan"
    score_digits: int = 9
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    nprobe: int = 8
    embedding_dim: int = 64
    # The column of a chunk table that holds the text, where it is not `text`.
    text_field: str = "text"
    # A query block is sent to every task only while it has at most this many rows and bytes;
    # larger batches are tiled with a shuffle instead.
    block_queries: int = 2048
    block_bytes: int = 64 * 1024 * 1024
    tile_queries: int = 512
    tile_chunks: int = 20000

    def __post_init__(self):
        if self.vector_mode not in ("exact", "ivf"):
            raise ValueError("vector_mode must be 'exact' or 'ivf'")
        if self.text_mode not in ("bm25", "scan", "bm25_then_scan"):
            raise ValueError("text_mode must be 'bm25', 'scan' or 'bm25_then_scan'")


@dataclass(frozen=True)
class PlannerConfig:
    """Whitelists and limits of a cleaned query plan."""

    domains: tuple = DOMAINS
    sections: tuple = SECTIONS
    default_top_k: int = DEFAULT_TOP_K
    max_tags: int = MAX_TAGS
