"""Text features: tokens, terms and signed feature hashing, one row in, one row out.

Tokens and terms are built-in expressions and stay in the JVM; codes are a kernel, which hashes what recurs once.
Nothing here shuffles: a request keeps its row, and its features are an array in it.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The token grammar, the white-space set it excludes, and the limits.
WHITE_SPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
TOKEN_PATTERN = r"[A-Za-z_][A-Za-z0-9_./-]*|\p{Nd}+|\S"
# White space that the engine's \S does not know: rare, so it is replaced beforehand, which
# is three times as fast as listing it in the pattern.
# The leading range turns common characters down at once, which doubles the speed of the search.
RARE_SPACE = (
    r"[[\x{0}-\x{8}\x{e}-\x{1f}\x{7f}-\x{10ffff}]&&"
    r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
# Fixed value: the tokens that imported heads were trained on; whole texts are the default elsewhere.
TOKEN_LIMIT = 4000
LENGTH_BUCKETS = 15
LENGTH_BUCKET_WIDTH = 64

MAX_DIMENSION = 1 << 30
DEFAULT_DIMENSION = 4096
DEFAULT_SEED = "waypost-v1"

FEATURE_TYPE = "array<struct<idx:int,v:double>>"
#: Elements of lists that a kernel takes at once: its work space is some 70 bytes for each, whatever a batch holds.
ELEMENTS_AT_ONCE = 1 << 20
#: Pairs of words that are spelled out and hashed at once.
PAIRS_AT_ONCE = 1 << 16
#: Codes of rows are counted in full rows of buckets where these hold at most so many cells a code.
CELLS_PER_CODE = 4


def check_dimension(dimension: int) -> int:
    if not 0 < dimension <= MAX_DIMENSION:
        raise ValueError("feature dimension must be positive and at most 2**30")
    return dimension


def is_blank(text: Column) -> Column:
    """True for null text and for text made of white space only."""
    return ~F.coalesce(text.rlike(f"[^{WHITE_SPACE}]"), F.lit(False))


def tokens(text: Column, limit: int | None = None) -> Column:
    """Lower-cased tokens of a text: all of them, or the first `limit` where a caller asks for that."""
    spaced = F.when(text.rlike(RARE_SPACE), F.regexp_replace(text, RARE_SPACE, " ")).otherwise(text)
    found = F.regexp_extract_all(spaced, F.lit(TOKEN_PATTERN), F.lit(0))
    taken = found if limit is None else F.slice(found, 1, limit)
    return F.transform(taken, lambda token: F.lower(token))


def terms(token_array: Column, prefix: str = "") -> Column:
    """Unigram, adjacent-pair and length terms of a token array.

    `token_array` must be a plain column: it is read several times.
    """
    count = F.size(token_array)
    pairs = F.greatest(F.lit(0), count - 1)
    return F.concat(
        F.transform(token_array, lambda token: F.concat(F.lit(f"{prefix}u:"), token)),
        F.zip_with(
            F.slice(token_array, F.lit(1), pairs),
            F.slice(token_array, F.lit(2), pairs),
            lambda left, right: F.concat(F.lit(f"{prefix}b:"), left, F.lit("\x1f"), right),
        ),
        F.array(
            F.concat(
                F.lit(f"{prefix}length:"),
                F.least(F.lit(LENGTH_BUCKETS), F.floor(count / LENGTH_BUCKET_WIDTH)).cast("string"),
            )
        ),
    )


def _digest_codes(strings: list[bytes], dimension: int) -> np.ndarray:
    """Hash terms to `2 * bucket + sign_bit`.

    The bucket is the first eight digest bytes modulo the dimension, the sign bit is the low bit of the ninth.
    """
    digests = np.frombuffer(b"".join([sha256(term).digest()[:9] for term in strings]), np.uint8).reshape(-1, 9)
    buckets = np.ascontiguousarray(digests[:, :8]).view(">u8").ravel().astype(np.uint64) % np.uint64(dimension)
    return (buckets.astype(np.int64) * 2 + (digests[:, 8] & 1)).astype(np.int32)


def _list_lengths(lists: pa.Array) -> np.ndarray:
    """Elements per list of an Arrow list array, as `flatten` gives them: a null list has none."""
    return np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)


def _piece_codes(token_lists: pa.Array, dimension: int, prefix: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the terms of some token lists, and how many each list has: tokens, pairs, length, as in `terms`."""
    count, given = _list_lengths(token_lists), np.asarray(token_lists.is_valid())
    offsets = np.concatenate([[0], np.cumsum(count)])
    # A null list has no term, not even its length.
    sizes = count + np.maximum(count - 1, 0) + given
    first = np.cumsum(sizes) - sizes
    codes = np.empty(int(sizes.sum()), np.int32)
    codes[(first + sizes - 1)[given]] = lengths[np.minimum(LENGTH_BUCKETS, count[given] // LENGTH_BUCKET_WIDTH)]
    encoded = token_lists.flatten().cast(pa.binary()).dictionary_encode()
    word, words = np.asarray(encoded.indices).astype(np.int64), encoded.dictionary.to_pylist()
    if not words:
        return codes, sizes
    place = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], count)
    codes[place] = _digest_codes([prefix + b"u:" + w for w in words], dimension)[word]
    # A pair begins at every token but the last of its list.
    begins = np.ones(offsets[-1], bool)
    begins[offsets[1:][count > 0] - 1] = False
    left = np.flatnonzero(begins)
    encoded = pa.array(word[left] * len(words) + word[left + 1]).dictionary_encode()
    pairs = np.asarray(encoded.dictionary)
    heads = [prefix + b"b:" + w + b"\x1f" for w in words]
    hashed = np.empty(len(pairs), np.int32)
    for start in range(0, len(pairs), PAIRS_AT_ONCE):
        some = pairs[start : start + PAIRS_AT_ONCE]
        ends = zip((some // len(words)).tolist(), (some % len(words)).tolist())
        hashed[start : start + len(some)] = _digest_codes([heads[i] + words[j] for i, j in ends], dimension)
    codes[place[left] + np.repeat(count, np.maximum(count - 1, 0))] = hashed[np.asarray(encoded.indices)]
    return codes, sizes


def list_codes(token_lists: pa.Array, dimension: int, seed: str) -> pa.Array:
    """Hashed term codes of an Arrow array of token lists; a null list has none.

    Words and pairs recur, so each distinct one of a piece of the batch is hashed once.
    """
    prefix = f"{seed}:".encode()
    lengths = _digest_codes([prefix + b"length:%d" % bucket for bucket in range(LENGTH_BUCKETS + 1)], dimension)
    parts, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for first, end in pieces(np.asarray(token_lists.offsets)):
        codes, size = _piece_codes(token_lists.slice(first, end - first), dimension, prefix, lengths)
        parts.append(codes)
        sizes.append(size)
    ends = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
    nulls = pa.array(np.asarray(token_lists.is_null())) if token_lists.null_count else None
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts)), mask=nulls)


def term_codes(token_lists: Column, dimension: int, seed: str) -> Column:
    """Hashed codes of the terms of a token array, as an Arrow-batched kernel.

    SHA-256 is most of the work of a text: taken term by term in the engine it costs some ten times as much.
    """
    check_dimension(dimension)

    @F.arrow_udf("array<int>")
    def codes(batch: pa.Array) -> pa.Array:
        return list_codes(batch, dimension, seed)

    return codes(token_lists)


def with_codes(df, text: str = "text", out: str = "codes", *, dimension: int, seed: str, limit: int | None = None):
    """Add the hashed term codes of a text column, of its first `limit` tokens if given."""
    return df.withColumn(out, term_codes(tokens(F.col(text), limit), dimension, seed))


def _list_parts(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number per element and flat values of an Arrow list array."""
    return np.repeat(np.arange(len(codes)), _list_lengths(codes)), np.asarray(codes.flatten())


def pieces(offsets: np.ndarray, most: int | None = None) -> list[tuple[int, int]]:
    """Runs of rows (first, end) of at most `most` (ELEMENTS_AT_ONCE) list elements each, or of one row."""
    found, first, rows = [], 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + (most or ELEMENTS_AT_ONCE), side="right")) - 1
        end = min(max(end, first + 1), rows)
        found.append((first, end))
        first = end
    return found


def bucket_counts(codes: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of one Arrow batch (row, bucket, net sign count other than zero), and the L2 norm of every row."""
    rows, values = _list_parts(codes)
    keys, signs = rows.astype(np.int64) * dimension + (values >> 1), (values & 1) * 2.0 - 1.0
    if len(codes) * dimension <= CELLS_PER_CODE * len(values):
        cells = np.bincount(keys, weights=signs, minlength=len(codes) * dimension)
        keys = np.flatnonzero(cells)
        counts = cells[keys]
    else:
        keys, where = np.unique(keys, return_inverse=True)
        counts = np.bincount(where, weights=signs, minlength=len(keys))
        kept = counts != 0
        keys, counts = keys[kept], counts[kept]
    row, bucket = keys // dimension, (keys % dimension).astype(np.int32)
    return row, bucket, counts, np.sqrt(np.bincount(row, weights=counts * counts, minlength=len(codes)))


def net_counts(codes: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of one Arrow batch: (row, bucket, L2-normed net sign count)."""
    row, bucket, counts, norms = bucket_counts(codes, dimension)
    return row, bucket, counts / norms[row]


def hashed_features(codes: Column, dimension: int) -> Column:
    """L2-normed sparse vector of a code array, as an array of (idx, v).

    Spark has no built-in that sums by key inside one array, and exploding the terms
    would shuffle several times the volume of the text, so this one step is an
    Arrow-batched NumPy kernel over integers.
    """

    @F.arrow_udf(FEATURE_TYPE)
    def build(batch: pa.Array) -> pa.Array:
        # At most a feature per code; what stays empty takes no memory.
        most = len(batch.flatten())
        buckets, values, ends, size = np.empty(most, np.int32), np.empty(most), np.zeros(len(batch) + 1, np.int32), 0
        for first, end in pieces(np.asarray(batch.offsets)):
            row, bucket, value = net_counts(batch.slice(first, end - first), dimension)
            ends[first + 1 : end + 1] = size + np.searchsorted(row, np.arange(1, end - first + 1))
            buckets[size : size + len(row)], values[size : size + len(row)] = bucket, value
            size += len(row)
        cells = pa.StructArray.from_arrays([pa.array(buckets[:size]), pa.array(values[:size])], ["idx", "v"])
        return pa.ListArray.from_arrays(pa.array(ends), cells)

    return build(codes)


def linear_margins(codes: Column, weights: np.ndarray, biases: np.ndarray) -> Column:
    """Bias + weights · features for every model of the pool, in pool order.

    `weights` is a (dimension × models) matrix whose size the caller has checked.
    """
    dimension, models = weights.shape

    @F.arrow_udf("array<double>")
    def margins(batch: pa.Array) -> pa.Array:
        result = np.tile(biases, (len(batch), 1))
        for first, end in pieces(np.asarray(batch.offsets)):
            row, bucket, value = net_counts(batch.slice(first, end - first), dimension)
            for model in range(models):
                result[first:end, model] += np.bincount(
                    row, weights=weights[bucket, model] * value, minlength=end - first
                )
        ends = pa.array(np.arange(0, models * len(batch) + 1, models, dtype=np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(result.ravel()))

    return margins(codes)


def feature_rows(df, keys: list[str], features: str = "features"):
    """Sparse vectors to one row per (…, idx, v).

    Zipping the two fields first keeps the optimizer from adding a filter on the size of
    the vector, for which it would run the kernel a second time.
    """
    parts = df.select(*keys, F.col(f"{features}.idx").alias("idx"), F.col(f"{features}.v").alias("v"))
    return parts.select(*keys, F.inline(F.arrays_zip("idx", "v")))
