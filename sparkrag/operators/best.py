"""The k best of a stream of rows for each of a set of queries, in NumPy; memory depends on queries and k, not on the stream.

Vectors are multiplied in tiles and in single precision; only pairs whose product is within its error of a query's k-th
best score are scored exactly, in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..errors import VectorIndexError
from ..functions.vectors import EPSILON

DIGITS = 9  # scores are rounded before they are ranked, so that ties don't depend on the order of additions
TILE = 1024, 2048  # queries, nodes
PAIRS = 1 << 15  # scored exactly at a time


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix; vectors of another length, absent ones too, are an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if (wrong := sizes != dim).any():
        got = sizes[wrong][0]
        raise VectorIndexError(f"expected {dim} dimensions, got {'none' if got < 0 else got}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def ids_of(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), object)


class Best:
    """The k best rows of each query: by score from the highest (NaN before all), then by id."""

    def __init__(self, m: int, k: int):
        self.m, self.k, self.n = m, k, np.zeros(m, np.int64)
        self.score, self.ids = np.zeros((m, 0)), np.zeros((m, 0), object)
        self.edge = np.full(m, -np.inf)  # the k-th best score, below which nothing is kept

    def _widen(self, kind: np.dtype) -> None:
        """Room for k rows a query, doubled as it is needed."""
        width = min(self.k, max(16, 2 * self.score.shape[1]))
        score, ids = np.zeros((self.m, width)), np.zeros((self.m, width), kind)
        score[:, : self.score.shape[1]], ids[:, : self.ids.shape[1]] = self.score, self.ids
        self.score, self.ids = score, ids

    def put(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows for queries ``at``, each with its score and id."""
        keep = ~(score < self.edge[at])
        at, score, ids = at[keep], score[keep], ids[keep]
        if not len(at):
            return
        if not self.score.shape[1]:
            self.ids = self.ids.astype(ids.dtype)
        rows = np.unique(at)
        old = np.repeat(rows, self.n[rows])
        place = np.arange(len(old)) - np.repeat(np.cumsum(self.n[rows]) - self.n[rows], self.n[rows])
        at, score, ids = np.concatenate([old, at]), np.concatenate([self.score[old, place], score]), np.concatenate([self.ids[old, place], ids])
        nan = np.isnan(score)
        order = np.lexsort((ids, -np.where(nan, np.inf, score), ~nan, at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.searchsorted(at, rows)
        sizes = np.diff(np.append(first, len(at)))
        place = np.arange(len(at)) - np.repeat(first, sizes)
        keep = place < self.k
        at, score, ids, place = at[keep], score[keep], ids[keep], place[keep]
        while place.max() >= self.score.shape[1]:
            self._widen(self.ids.dtype)
        self.score[at, place], self.ids[at, place], self.n[rows] = score, ids, np.minimum(sizes, self.k)
        full = rows[self.n[rows] == self.k]
        last = self.score[full, self.k - 1] if len(full) else self.edge[full]
        self.edge[full] = np.where(np.isnan(last), np.inf, last)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of all that is kept, in order."""
        at = np.repeat(np.arange(self.m), self.n)
        place = np.arange(len(at)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        return at, self.ids[at, place], self.score[at, place]


class Vectors:
    """Scores of a block of query vectors against batches of nodes."""

    def __init__(self, q: np.ndarray, metric: str):
        self.q, self.metric, self.m, self.dim = q, metric, *q.shape
        self.norm = np.sqrt(np.einsum("ij,ij->i", q, q, dtype=np.float64))
        self.sides = {}

    def _side(self, x: np.ndarray, norm: np.ndarray, node: bool, kind: type) -> np.ndarray:
        """Factors of the product: cosines of unit vectors, else products, or for distances 2qv - vv."""
        if self.metric == "cosine":
            return (x / np.where(norm > 0, norm, 1)[:, None]).astype(kind)
        if self.metric == "dot":
            return x.astype(kind)
        out = np.empty((len(x), self.dim + 1), kind)
        out[:, :-1], out[:, -1] = (2.0 * x, -(norm**2)) if node else (x, 1)
        return out

    def exact(self, at: np.ndarray, v: np.ndarray, norm: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Rounded scores of pairs (query, node), each in double precision and in the same order of additions."""
        out = np.empty(len(at))
        for i in range(0, len(at), PAIRS):
            a, b = at[i : i + PAIRS], of[i : i + PAIRS]
            x, y = self.q[a].astype(np.float64), v[b].astype(np.float64)
            if self.metric == "euclidean":
                x -= y
                out[i : i + PAIRS] = -np.sqrt(np.einsum("ij,ij->i", x, x))
            else:
                s = np.einsum("ij,ij->i", x, y)
                out[i : i + PAIRS] = s / (self.norm[a] * norm[b] + EPSILON) if self.metric == "cosine" else s
        return np.round(out, DIGITS) + 0.0

    def tiles(self, v: np.ndarray, norm: np.ndarray, kind: type = np.float32, rows: int = TILE[0]):
        """(slice of queries, slice of nodes, products, their greatest error a query). The products hold until the next tile."""
        with np.errstate(over="ignore", invalid="ignore"):
            if np.nanmax(self.norm, initial=0) * np.nanmax(norm, initial=0) > 1e30 or np.nanmax(norm, initial=0) > 1e15:
                kind = np.float64
            if kind not in self.sides:
                self.sides = {kind: self._side(self.q, self.norm, False, kind)}
            own = self.sides[kind]
            unit = (self.dim + 4) * 2 * np.finfo(kind).eps
            for j in range(0, len(v), TILE[1]):
                nodes = slice(j, min(j + TILE[1], len(v)))
                other, far = self._side(v[nodes], norm[nodes], True, kind), norm[nodes]
                most, least = np.nanmax(far, initial=0), np.min(far[far > 0], initial=np.inf)
                for i in range(0, self.m, rows):
                    mine = slice(i, min(i + rows, self.m))
                    near = self.norm[mine]
                    s = own[mine] @ other.T
                    if self.metric == "cosine":
                        if np.min(near[near > 0], initial=np.inf) * least < 1e-2:  # the summand beside the norms counts
                            both = np.outer(near, far)
                            s *= (both / (both + EPSILON)).astype(kind)
                        error = np.full(len(near), unit + (2e-6 if kind is np.float32 else 0))
                    else:
                        error = unit * (near * most if self.metric == "dot" else 2 * (near + most) ** 2)
                    yield mine, nodes, s, error

    def _least(self, edge: np.ndarray, mine: slice) -> np.ndarray:
        """The product that a score of at least ``edge`` has, but for its error."""
        if self.metric != "euclidean":
            return edge - 2 * 10.0**-DIGITS
        with np.errstate(invalid="ignore"):
            return np.where(edge > 0, np.inf, self.norm[mine] ** 2 - (np.abs(edge) + 2 * 10.0**-DIGITS) ** 2)

    def add(self, best: Best, ids: np.ndarray, v: np.ndarray) -> None:
        """A batch of nodes to the best of their queries."""
        norm = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
        for mine, nodes, s, error in self.tiles(v, norm, rows=max(1, min(TILE[0], (1 << 22) // (best.k + TILE[1])))):
            edge = best.edge[mine]
            least = self._least(edge, mine) - error
            width = s.shape[1]
            if np.isneginf(edge).any() and width > best.k:  # the tile's own k-th best bounds what can stay
                own = np.partition(s, width - best.k, axis=1)[:, width - best.k] - 2 * error - 2 * 10.0**-DIGITS * (1 if self.metric != "euclidean" else 2 * (self.norm[mine] + norm[nodes].max(initial=0)))
                least = np.where(np.isneginf(edge), own, least)
            least = np.nextafter(least.astype(s.dtype), s.dtype.type(-np.inf))
            hot = np.flatnonzero(~(s.max(1) < least))
            if len(hot):
                at, of = np.nonzero(~(s[hot] < least[hot, None]))
                at, of = hot[at] + mine.start, of + nodes.start
                best.put(at, self.exact(at, v, norm, of), ids[of])

    def extremes(self, low: np.ndarray, high: np.ndarray, v: np.ndarray) -> None:
        """The least and the greatest score of each query, with those of a batch."""
        norm = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
        for mine, nodes, s, _ in self.tiles(v, norm, np.float64):
            at = np.arange(mine.start, mine.stop)
            high[mine] = np.maximum(high[mine], self.exact(at, v, norm, nodes.start + s.argmax(1)))
            low[mine] = np.minimum(low[mine], self.exact(at, v, norm, nodes.start + s.argmin(1)))


class Terms:
    """Weighted words of queries, to be multiplied with those of nodes: a sparse score is the sum over common words."""

    ROWS, WORDS = 512, 1024  # queries and words that are multiplied at a time

    def __init__(self, at: np.ndarray, tokens: list, weight: np.ndarray, m: int):
        self.m, self.vocabulary = m, {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        order = np.argsort(at, kind="stable")
        self.at, self.weight = at[order], weight[order]
        self.token = np.fromiter(map(self.vocabulary.__getitem__, tokens), np.int64, len(tokens))[order]

    def of_texts(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, word, count) of lower-cased texts in UTF-8, words being runs of what isn't ASCII's white space."""
        found = [[i for w in t.split() if (i := self.vocabulary.get(w)) is not None] if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.repeat(np.arange(len(found)), sizes), np.fromiter((i for x in found for i in x), np.int64, int(sizes.sum())), np.ones(int(sizes.sum()))

    def of_maps(self, keys: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of lists of words and of their weights."""
        sizes = keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        token = np.fromiter((self.vocabulary.get(w, -1) for w in keys.flatten().to_pylist()), np.int64, int(sizes.sum()))
        at, weight = np.repeat(np.arange(len(keys)), sizes), values.flatten().to_numpy(zero_copy_only=False)
        return at[token >= 0], token[token >= 0], weight[token >= 0]

    def product(self, mine: slice, nodes: slice, of: np.ndarray, token: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sparse scores of some queries and nodes; ``of`` ascends."""
        (a, b), (x, y) = np.searchsorted(of, [nodes.start, nodes.stop]), np.searchsorted(self.at, [mine.start, mine.stop])
        of, token, weight, at, own, by = of[a:b] - nodes.start, token[a:b], weight[a:b], self.at[x:y] - mine.start, self.token[x:y], self.weight[x:y]
        m, n = mine.stop - mine.start, nodes.stop - nodes.start
        out, here, asked = np.zeros((m, n)), np.zeros(len(self.vocabulary), bool), np.zeros(len(self.vocabulary), bool)
        here[token] = asked[own] = True
        both = np.flatnonzero(here & asked)
        for i in range(0, len(both), self.WORDS):
            place = np.full(len(self.vocabulary), -1)
            place[both[i : i + self.WORDS]] = np.arange(p := len(both[i : i + self.WORDS]))
            left, right = place[own], place[token]
            w = np.bincount((at * p + left)[left >= 0], by[left >= 0], m * p).reshape(m, p)
            c = np.bincount((right * n + of)[right >= 0], weight[right >= 0], p * n).reshape(p, n)
            out += w @ c
        return out

    def tiles(self, postings: tuple[np.ndarray, np.ndarray, np.ndarray], n: int):
        for j in range(0, n, TILE[1]):
            for i in range(0, self.m, self.ROWS):
                mine, nodes = slice(i, min(i + self.ROWS, self.m)), slice(j, min(j + TILE[1], n))
                yield mine, nodes, self.product(mine, nodes, *postings)

    def add(self, best: Best, ids: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """A batch of nodes that have words of a query, to its best; weights are greater than 0."""
        for mine, nodes, s in self.tiles(postings, len(ids)):
            least = best.edge[mine]
            if np.isneginf(least).any() and s.shape[1] > best.k:
                least = np.maximum(least, np.partition(s, s.shape[1] - best.k, axis=1)[:, s.shape[1] - best.k])
            at, of = np.nonzero((s > 0) & ~(s < least[:, None]))
            best.put(at + mine.start, s[at, of], ids[of + nodes.start])


class Fused:
    """alpha * dense + (1 - alpha) * sparse, both scaled to 0..1 by the extremes (columns lo, hi) over all nodes of a query."""

    def __init__(self, vectors: Vectors, terms: Terms, alpha: float, dense: np.ndarray, sparse: np.ndarray):
        self.vectors, self.terms, self.alpha, self.dense, self.sparse = vectors, terms, alpha, dense, sparse

    @staticmethod
    def scaled(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        span = high - low
        return np.where(span < 1e-8, 1.0, (x - low) / np.where(span < 1e-8, 1, span))

    def add(self, best: Best, ids: np.ndarray, v: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        norm, one = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64)), self.vectors
        for mine, nodes, s, error in one.tiles(v, norm, np.float64, self.terms.ROWS):
            if one.metric == "euclidean":
                s, error = -np.sqrt(np.maximum(one.norm[mine, None] ** 2 - s, 0)), np.sqrt(error)
            low, high = self.dense[mine, :1], self.dense[mine, 1:]
            error = self.alpha * (error + 10.0**-DIGITS) / np.maximum(high - low, 1e-8)[:, 0] + 2 * 10.0**-DIGITS
            other = self.terms.product(mine, nodes, *postings)
            s = self.alpha * self.scaled(s, low, high) + (1 - self.alpha) * self.scaled(other, self.sparse[mine, :1], self.sparse[mine, 1:])
            least = best.edge[mine]
            if np.isneginf(least).any() and s.shape[1] > best.k:
                least = np.maximum(least, np.partition(s, s.shape[1] - best.k, axis=1)[:, s.shape[1] - best.k] - error)
            at, of = np.nonzero(~(s < (least - error)[:, None]))
            x = self.scaled(one.exact(at + mine.start, v, norm, of + nodes.start), low[at, 0], high[at, 0])
            y = self.scaled(other[at, of], self.sparse[at + mine.start, 0], self.sparse[at + mine.start, 1])
            best.put(at + mine.start, np.round(self.alpha * x + (1.0 - self.alpha) * y, DIGITS) + 0.0, ids[of + nodes.start])
