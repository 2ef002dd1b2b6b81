from .columns import (
    char_ngrams,
    cosine_distance,
    dot,
    jaccard,
    l2,
    l2_normalize,
    sq_l2,
    truncate_tokens,
    unicode_trim,
    vector_norm,
)

__all__ = [
    "char_ngrams",
    "cosine_distance",
    "dot",
    "jaccard",
    "l2",
    "l2_normalize",
    "sq_l2",
    "truncate_tokens",
    "unicode_trim",
    "vector_norm",
]
