"""Column functions: all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whitespace_clean(c) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def normalize_query(c) -> Column:
    return F.lower(whitespace_clean(c))


def content_or_transcription(a, b) -> Column:
    """The first of two strings that is not empty, else ''."""
    return F.coalesce(F.nullif(_c(a), F.lit("")), F.nullif(_c(b), F.lit("")), F.lit(""))


def content_preview(a, b, n: int = 200, missing: str = "No content available") -> Column:
    """The first n characters of what there is, with an ellipsis if there is more."""
    text = content_or_transcription(a, b)
    return F.when(text == "", F.lit(missing)).when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def file_extension(path, title) -> Column:
    """Lower-case extension with its dot: of the path; without one of the title; a name without a dot is its own extension."""
    tail = lambda c: F.concat(F.lit("."), F.element_at(F.split(F.lower(c), r"\."), -1))
    path, title = _c(path), _c(title)
    return F.when(F.coalesce(path, F.lit("")) != "", tail(path)).when(F.coalesce(title, F.lit("")).contains("."), tail(title)).otherwise(F.lit(".unknown"))


def has_vector(c) -> Column:
    return F.coalesce(F.size(_c(c)) > 0, F.lit(False))


def status_waterfall(status="transcription_status", content="content_text", transcription="transcription", embedding="embedding") -> Column:
    """error, embedded, processed or pending: the first that holds."""
    text = content_or_transcription(content, transcription) != ""
    return F.when(_c(status) == "error", "error").when(has_vector(embedding), "embedded").when(text, "processed").otherwise("pending")


def json_field(c, path: str) -> Column:
    return F.get_json_object(_c(c), path)


def content_hash(c) -> Column:
    """SHA-256 of the cleaned text, in lower-case hex."""
    return F.sha2(whitespace_clean(c), 256)


def word_count(c) -> Column:
    return F.size(F.filter(F.split(_c(c), r"\s+"), lambda w: w != ""))


def token_estimates(c) -> Column:
    """Tokens by characters / 4, by characters / 3 and by words * 1.3."""
    text = F.coalesce(_c(c), F.lit(""))
    return F.struct(F.ceil(F.length(text) / 4).cast("long").alias("by_quarter"), F.ceil(F.length(text) / 3).cast("long").alias("by_third"), F.floor(word_count(text) * 1.3).cast("long").alias("by_words"))


# The model's tokens, the share of them that is used, characters a token, the longest text and what is cut from it.
def truncate_for_model(c, mode: str = "chars", tokens: int = 8191, most: int = 18_000) -> Column:
    """'tokens': at most 0.9 of the model's tokens at four characters each; 'chars': 17,950 characters and a notice."""
    text = _c(c)
    if mode == "tokens":
        keep = int(0.9 * tokens * 4)
        return F.when(F.length(text) / 4 > 0.9 * tokens, F.substring(text, 1, keep)).otherwise(text)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 50), F.lit("... [truncated]"))).otherwise(text)


def chunk_type(c) -> Column:
    """code, table, list or text, by the first pattern that the text matches."""
    text = _c(c)
    code = text.rlike(r"(?s)```.*```") | text.rlike(r"(?m)^\s*(function|class|def|interface|const|let|var)\s+")
    table = text.rlike(r"\|.*\|.*\|") | text.rlike(r"(?m)^\s*\+[-+]+\+\s*$")
    listed = text.rlike(r"(?m)^\s*[-*+•]\s+") | text.rlike(r"(?m)^\s*\d+\.\s+")
    return F.when(code, "code").when(table, "table").when(listed, "list").otherwise("text")


def ordered_dedup_limit(c, n: int = 100) -> Column:
    return F.slice(F.array_distinct(_c(c)), 1, n)


def _doubles(c) -> Column:
    return _c(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine in double precision; null, empty, zero or unequally long vectors have 0. Norms that are columns already can be passed."""
    na, nb = (norm(a) if norm_a is None else _c(norm_a)), (norm(b) if norm_b is None else _c(norm_b))
    fits = (F.size(_c(a)) == F.size(_c(b))) & (na > 0) & (nb > 0)
    return F.when(F.coalesce(fits, F.lit(False)), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def combine_embeddings(vectors: list, weights: list[float]) -> Column:
    """Weighted mean of the vectors that are there; null if none is."""
    parts = [(F.when(has_vector(v), _doubles(v)), w) for v, w in zip(vectors, weights, strict=True)]
    total = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in parts), F.lit(0.0))
    times = lambda v, w: F.transform(v, lambda x: x * w)
    scaled = F.filter(F.array(*[times(v, w) for v, w in parts]), lambda v: v.isNotNull())
    summed = F.aggregate(F.slice(scaled, 2, F.greatest(F.size(scaled) - 1, F.lit(0))), F.get(scaled, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(total > 0, F.transform(summed, lambda x: x / total))


# Weights of the parts of an embedding, by kind of content.
EMBEDDING_WEIGHTS = {
    "default": {"text": 0.4, "visual": 0.3, "technical": 0.2, "context": 0.1},
    "frame": {"visual": 0.5, "text": 0.3, "technical": 0.15, "context": 0.05},
    "technical_document": {"text": 0.5, "technical": 0.3, "visual": 0.2},
    "document": {"text": 0.7, "visual": 0.2, "technical": 0.1},
    "image": {"visual": 0.7, "text": 0.3},
    "mixed": {"visual": 0.5, "text": 0.5},
}


def embedding_weights(kind: str = "default") -> dict[str, float]:
    return EMBEDDING_WEIGHTS["default"] | EMBEDDING_WEIGHTS.get(kind, {})


def combined_confidence(visual_confidence, has_text, text_weight: float = 0.5, visual_weight: float = 0.5) -> Column:
    """Weighted mean of 0.9 for text and the visual confidence, of what there is; 0.5 without either."""
    t = F.when(_c(has_text), F.lit(text_weight)).otherwise(F.lit(0.0))
    v = F.when(_c(visual_confidence).isNotNull(), F.lit(visual_weight)).otherwise(F.lit(0.0))
    return F.when(t + v > 0, (t * 0.9 + F.coalesce(_c(visual_confidence), F.lit(0.0)) * v) / (t + v)).otherwise(F.lit(0.5))


def parse_embedding(c) -> Column:
    """A vector from an array or its JSON text; anything else is null."""
    return F.from_json(_c(c), "array<double>")


def url_host(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^https?://([^/?#]+)", 1))
