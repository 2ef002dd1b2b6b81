from .lexicon import NULL_TOKENS, find_first_match, read_first_match, read_lexicon, read_vocab
from .tables import (
    read_assignments,
    read_coherence,
    read_embeddings,
    read_metrics,
    write_assignments,
    write_coherence,
    write_embeddings,
    write_metrics,
)
from .columns import normalize_columns, require_columns

__all__ = [
    "NULL_TOKENS",
    "find_first_match",
    "normalize_columns",
    "read_assignments",
    "read_coherence",
    "read_embeddings",
    "read_first_match",
    "read_lexicon",
    "read_metrics",
    "read_vocab",
    "require_columns",
    "write_assignments",
    "write_coherence",
    "write_embeddings",
    "write_metrics",
]
