"""Embedding texts and scanning vectors with numpy inside Arrow batches."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook import vocab

Embedder = Callable[[list[str]], np.ndarray]
EmbedderFactory = Callable[[], Embedder]

# Between the texts of a batch; it is in no token.
_BORDER = "\x00"
# Bytes that are in no token (``[a-z0-9]+``) become blanks, the border stays.
_TOKEN_BYTES = bytes(c if c == 0 or chr(c) in string.ascii_lowercase + string.digits else 32 for c in range(256))


def hashed_tokens(dim: int = vocab.EMBEDDING_DIM) -> EmbedderFactory:
    """Default embedder: token counts in ``dim`` hash buckets, no model, no network.

    The texts of a batch are lowered, cut into tokens and counted together.
    """

    class Buckets(dict):
        def __missing__(self, token: bytes) -> int:
            if len(self) > 1_000_000:
                self.clear()
                self[_BORDER.encode()] = -1
            bucket = self[token] = int(hashlib.md5(token).hexdigest()[:8], 16) % dim
            return bucket

    def load() -> Embedder:
        buckets = Buckets({_BORDER.encode(): -1})

        def embed(texts: list[str]) -> np.ndarray:
            joined = _BORDER.join([text or "" for text in texts])
            if joined.count(_BORDER) >= len(texts):
                joined = _BORDER.join([(text or "").replace(_BORDER, " ") for text in texts])
            cut = joined.lower().encode("utf-8", "replace").translate(_TOKEN_BYTES)
            tokens = cut.replace(_BORDER.encode(), b" \x00 ").split()
            found = np.fromiter(map(buckets.__getitem__, tokens), np.int64, len(tokens))
            border = found < 0
            places = (np.cumsum(border) * dim + found)[~border]
            return np.bincount(places, minlength=len(texts) * dim).reshape(-1, dim).astype(np.float32)

        return embed

    return load


def embedding_of(text: Column, factory: EmbedderFactory | None = None) -> Column:
    """``array<float>`` for a text column; the model is loaded once per task."""
    make = factory or hashed_tokens()

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for texts in batches:
            matrix = np.ascontiguousarray(model(texts.to_pylist()), dtype=np.float32)
            width = matrix.shape[1]
            starts = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * width)
            yield pa.ListArray.from_arrays(starts, pa.array(matrix.reshape(-1)))

    return embed(text)


def with_embedding(df: DataFrame, factory: EmbedderFactory | None = None) -> DataFrame:
    """Add ``embedding`` for the ``chunk`` text."""
    return df.withColumn("embedding", embedding_of(F.col("chunk"), factory))


def to_matrix(vectors: pa.Array) -> np.ndarray:
    """A list column as a 2-d array."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


#: Query vectors and rows of one product, which stays in the cache of a core, and pairs whose exact
#: distances are computed at once.
_QUERY_TILE, _ROW_TILE, _PAIRS_AT_ONCE = 512, 512, 65_536


def _slack(dim: int) -> float:
    """More than single precision can be off in a product of unit vectors."""
    return 2 * (dim + 8) * 2.0**-24 + 1e-8


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in single precision; zero vectors stay."""
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return (vectors / np.where(lengths > 0, lengths, 1)).astype(np.float32)


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - cosine of each row of ``a`` and ``b``; a zero vector is at distance 1."""
    dots = np.einsum("ij,ij->i", a, b)
    squares = (a * a).sum(axis=1) * (b * b).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.round(1.0 - np.where(squares > 0, dots / np.sqrt(squares), 0.0), 9)


def candidate_scan(
    query_ids: pa.Array,
    queries: np.ndarray,
    k: int,
    vector_column: str,
    id_column: str,
    schema: pa.Schema,
    factory: EmbedderFactory | None = None,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition scan that passes on the rows that are among a query's k nearest in it.

    ``vector_column`` holds vectors, or texts when there is a ``factory``; texts are
    embedded on the spot, so their vectors never leave the worker.  Tiles of rows and queries
    are multiplied as unit vectors in single precision; only queries whose best row of the tile is
    near enough are looked at, and with some slack few pairs are left to compute exactly.  Those are gathered and cut to the k smallest of each query (ties by id,
    as in the final ranking) when there are twice as many; a partition gives at most k rows
    a query, once, at its end.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory() if factory else None
        asked, slack = _unit(queries), _slack(queries.shape[1])
        limit = np.full(len(queries), np.inf)  # no row farther than this is among the k nearest
        ids, names = None, None  # of the rows gathered so far
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]  # query, row in ``ids``, distance
        held, most = 0, max(2 * k * len(queries), 100_000)
        room = np.empty(_QUERY_TILE * _ROW_TILE, np.float32)

        def cut() -> None:
            nonlocal ids, names, parts, held
            owners, rows, distances = map(np.concatenate, zip(*parts, strict=True))
            _, places = np.unique(names, return_inverse=True)
            order = np.lexsort((places[rows], distances, owners))
            sorted_owners = owners[order]
            rank = np.arange(len(order)) - np.searchsorted(sorted_owners, sorted_owners)
            last = order[rank == k - 1]
            limit[owners[last]] = distances[last]
            order = order[rank < k]
            used, rows = np.unique(rows[order], return_inverse=True)
            ids, names = ids.take(pa.array(used)), names[used]
            parts, held = [(owners[order], rows, distances[order])], len(order)

        for batch in batches:
            new_ids = batch.column(batch.schema.get_field_index(id_column))
            new_names = new_ids.to_numpy(zero_copy_only=False)
            new_names = new_names.astype(str) if new_names.dtype == object else new_names
            source = batch.column(batch.schema.get_field_index(vector_column))
            matrix = model(source.to_pylist()).astype(np.float64) if model else to_matrix(source)
            for start in range(0, len(matrix), _ROW_TILE):
                piece = matrix[start:start + _ROW_TILE]
                unit, found = _unit(piece).T, []
                for first in range(0, len(queries), _QUERY_TILE):
                    near = slice(first, first + _QUERY_TILE)
                    tile = asked[near]
                    alike = np.matmul(tile, unit, out=room[:len(tile) * unit.shape[1]].reshape(len(tile), unit.shape[1]))
                    if alike.shape[1] > k and np.isinf(limit[near]).any():
                        limit[near] = np.minimum(limit[near], 1 - np.partition(alike, -k, axis=1)[:, -k] + slack)
                    least = (1 - limit[near] - slack).astype(np.float32)
                    asking = np.flatnonzero(~(alike.max(axis=1) < least))  # the largest is NaN where one is
                    if not len(asking):
                        continue
                    at = np.flatnonzero(alike[asking] >= least[asking][:, None])
                    owner, row = np.divmod(at, alike.shape[1])
                    owner = asking[owner] + first
                    for some in range(0, len(at), _PAIRS_AT_ONCE):
                        o, r = owner[some:some + _PAIRS_AT_ONCE], row[some:some + _PAIRS_AT_ONCE]
                        exact = pair_distances(queries[o], piece[r])
                        keep = exact <= limit[o]
                        found.append((o[keep], r[keep], exact[keep]))
                if not found:
                    continue
                owner, row, exact = map(np.concatenate, zip(*found, strict=True))
                if not len(owner):
                    continue
                used, place = np.unique(row, return_inverse=True)
                taken = new_ids.take(pa.array(used + start))
                parts.append((owner, place + (0 if ids is None else len(ids)), exact))
                names = new_names[used + start] if names is None else np.concatenate([names, new_names[used + start]])
                ids = taken if ids is None else pa.concat_arrays([ids, taken])
                held += len(owner)
                if held > most:
                    cut()
        if held:
            cut()
            owners, rows, distances = parts[0]
            arrays = [query_ids.take(pa.array(owners)), pa.array(distances), ids.take(pa.array(rows))]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return scan
