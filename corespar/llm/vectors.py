"""Vectors: decoding, the coarse grid (Voronoi cells of a codebook) and the anisotropic four-bit code.

A vector is usable if it has DIM finite numbers, not all of them zero; all others are left out by every operator here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 96
SAMPLE = 32_768  # vectors, at most, on which codebooks are fitted: a documented bound, every vector is coded
HASH_RANGE = 1_000_000


def usable_rows(ids: pa.Array, vectors: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The ids and unit vectors (float32) of the usable rows of one Arrow batch."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = vectors.offsets.to_numpy()
    long_enough = (np.diff(offsets) == dim) & vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(long_enough)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    flat = vectors.values.to_numpy(zero_copy_only=False)
    x = np.asarray(flat[(offsets[rows][:, None] + np.arange(dim)).ravel()], dtype=np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return ids.to_numpy(zero_copy_only=False)[rows][good].astype(np.int64), (x[good] / norm[good, None]).astype(np.float32)


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a contiguous matrix as one binary value each."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])


def unpacked(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The reverse of packed()."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, width), dtype)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros((0, width), dtype)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(len(column), width) if data.ctypes.data % np.dtype(dtype).itemsize == 0 else data.copy().view(dtype).reshape(len(column), width)


def scaled(x: np.ndarray) -> np.ndarray:
    """Bytes of each vector after its own scale."""
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True) / 127, 1e-12)
    return np.concatenate([scale.astype(np.float32).view(np.int8), np.rint(x / scale).astype(np.int8)], axis=1)


def unscaled(rows: np.ndarray) -> np.ndarray:
    return rows[:, 4:].astype(np.float32) * np.ascontiguousarray(rows[:, :4]).view(np.float32)


def rounding_error(rows: np.ndarray) -> np.ndarray:
    """The longest that the difference of a vector and its bytes can be."""
    return np.ascontiguousarray(rows[:, :4]).view(np.float32)[:, 0] * np.float32(0.5 * (rows.shape[1] - 4) ** 0.5)


def sample(df: DataFrame, id_col: str, vector_col: str, total: int, dim: int = DIM, bound: int = SAMPLE) -> np.ndarray:
    """At most `bound` usable unit vectors, picked by a hash of the id; only for fitting codebooks."""
    share = min(HASH_RANGE, int(HASH_RANGE * 1.1 * bound / max(1, total)) + 1)
    picked = df.select(id_col, vector_col).where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(HASH_RANGE)) < share).limit(2 * bound)
    table = picked.toArrow()
    if not table.num_rows:
        return np.zeros((0, dim), np.float32)
    ids, x = usable_rows(table.column(0).combine_chunks(), table.column(1).combine_chunks(), dim)
    return x[np.argsort(ids, kind="stable")][:bound]


def fit_cells(x: np.ndarray, cells: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means: unit centroids of the coarse grid."""
    if not len(x):
        return np.eye(1, x.shape[1], dtype=np.float32)
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centroids = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(x[a : a + 2048] @ centroids.T).argmax(axis=1) for a in range(0, len(x), 2048)])  # never all rows by all cells
        order = np.argsort(nearest, kind="stable")
        present, starts = np.unique(nearest[order], return_index=True)
        total = np.add.reduceat(x[order], starts, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centroids[present] = total / np.maximum(norm, 1e-9)
        empty = np.setdiff1d(np.arange(len(centroids)), present)
        centroids[empty] = x[rng.choice(len(x), len(empty))]
    return centroids.astype(np.float32)


MOST_CELLS = 16_384


def cell_count(rows: int) -> int:
    """A power of two near a sixteenth of the square root of the rows.

    Few wide cells and few probes find more than many narrow cells and many probes of the same total size, and copy less. Work per
    vector grows as the root of their number up to MOST_CELLS, which 70 billion rows reach; beyond, cells grow and are cut into parts.
    """
    return int(min(MOST_CELLS, max(8, 2 ** round(np.log2(max(64, rows) ** 0.5 / 16)))))


def nearest_cells(x: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` nearest cells of each vector, the nearest first; in blocks, so memory stays bounded."""
    probes = min(probes, len(centroids))
    out = np.empty((len(x), probes), dtype=np.int32)
    rows = max(64, min(4096, (1 << 21) // len(centroids)))
    for a in range(0, len(x), rows):
        s = x[a : a + rows] @ centroids.T
        top = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < s.shape[1] else np.tile(np.arange(probes), (len(s), 1))
        out[a : a + rows] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1)
    return out


class FourBitCode:
    """Product code with 16 words for each pair of dimensions, fitted and applied with the score-aware loss.

    The loss of coding x as y, with r = x - y, is |r|^2 + weight * <r, x>^2: the part of the residual that is parallel to x,
    which is what changes large inner products, costs (1 + weight) times as much as the rest. weight + 1 is
    (d - 1) * t^2 / (1 - t^2) for a score threshold t.
    """

    def __init__(self, words: np.ndarray, weight: float):
        self.words, self.weight = words, weight  # (subspaces, 16, width)

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = 0.25, rounds: int = 5, seed: int = 11) -> FourBitCode:
        d = x.shape[1]
        subspaces, width = d // 2, 2
        weight = max(0.0, (d - 1) * threshold**2 / (1 - threshold**2) - 1)
        rng = np.random.default_rng(seed)
        if not len(x):
            return cls(np.zeros((subspaces, 16, width), np.float32), weight)
        parts = x.reshape(len(x), subspaces, width)
        words = parts[rng.choice(len(x), 16, replace=len(x) < 16)].transpose(1, 0, 2).astype(np.float64).copy()
        code = cls(words, 0.0)
        for turn in range(rounds):
            code.weight = weight if turn >= 2 else 0.0  # two plain rounds first, to start from a sensible codebook
            picked = code.encode(x)
            rebuilt = code.decode(picked).reshape(parts.shape)
            rest = ((parts - rebuilt) * parts).sum(axis=2)  # <r_s, x_s>
            all_rest = rest.sum(axis=1)
            for s in range(subspaces):
                xs, k = parts[:, s].astype(np.float64), picked[:, s]
                other = all_rest - rest[:, s] + (xs * xs).sum(axis=1)
                n = np.bincount(k, minlength=16)
                right = np.stack([np.bincount(k, weights=xs[:, j] * (1 + code.weight * other), minlength=16) for j in range(2)], axis=1)
                left = np.zeros((16, 2, 2))
                for i in range(2):
                    for j in range(2):
                        left[:, i, j] = code.weight * np.bincount(k, weights=xs[:, i] * xs[:, j], minlength=16) + (n if i == j else 0)
                used = n > 0
                words[s][used] = np.linalg.solve(left[used], right[used][..., None])[..., 0]
        code.weight = weight
        code.words = words.astype(np.float32)
        return code

    def encode(self, x: np.ndarray, turns: int = 2) -> np.ndarray:
        """The word of each subspace (uint8): first the nearest, then improved subspace by subspace under the loss."""
        subspaces = self.words.shape[0]
        out = np.empty((len(x), subspaces), dtype=np.uint8)
        words = self.words.astype(np.float32)
        squares = (words**2).sum(axis=2)
        for a in range(0, len(x), 4096):
            parts = x[a : a + 4096].reshape(-1, subspaces, 2).astype(np.float32)
            dots = np.einsum("nsw,skw->nsk", parts, words, optimize=True)  # <x_s, c_k>
            plain = squares[None] - 2 * dots  # |x_s - c_k|^2 less a constant
            k = plain.argmin(axis=2)
            if self.weight:
                own = (parts**2).sum(axis=2)
                gap = own - np.take_along_axis(dots, k[..., None], axis=2)[..., 0]  # <x_s - c_k, x_s>
                total = gap.sum(axis=1)
                rows = np.arange(len(parts))
                for _ in range(turns):
                    for s in range(subspaces):
                        other = total - gap[:, s]
                        each = own[:, s, None] - dots[:, s]
                        k[:, s] = (plain[:, s] + self.weight * (other[:, None] + each) ** 2).argmin(axis=1)
                        gap[:, s] = each[rows, k[:, s]]
                        total = other + gap[:, s]
            out[a : a + 4096] = k
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The coded vectors. A dot product with one is the sum of the table entries <q_s, c_k> that the code picks."""
        return self.words[np.arange(self.words.shape[0])[None], codes].reshape(len(codes), -1)

    def tables(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables (bytes of a code, 256, questions) of whole numbers, and the base and step of each question.

        The dot product of a question and a coded vector is base + step times the sum of the entries that its bytes pick, but for
        half a step for each word.
        """
        t = np.einsum("skw,qsw->skq", self.words, asked.reshape(len(asked), self.words.shape[0], 2), optimize=True)
        low = t.min(axis=1)
        step = np.maximum((t.max(axis=1) - low).sum(axis=0), 1e-9) / 65_000  # so that no sum leaves sixteen bits
        whole = np.rint((t - low[:, None]) / step).astype(np.uint16)
        both = whole[0::2][:, :, None] + whole[1::2][:, None]
        return both.reshape(both.shape[0], 256, len(asked)), low.sum(axis=0), step

    @staticmethod
    def scan(tables: np.ndarray, columns: np.ndarray, block: int = 2048) -> np.ndarray:
        """Sums of looked-up entries (coded rows, questions); columns: the codes byte by byte, (bytes, rows) as indices."""
        n = columns.shape[1]
        out = np.empty((n, tables.shape[2]), np.uint16)
        looked_up = np.empty((min(n, block), tables.shape[2]), np.uint16)
        for a in range(0, n, block):
            part = out[a : a + block]
            np.take(tables[0], columns[0, a : a + block], axis=0, out=part, mode="clip")
            for byte in range(1, len(columns)):
                np.take(tables[byte], columns[byte, a : a + block], axis=0, out=looked_up[: len(part)], mode="clip")
                part += looked_up[: len(part)]
        return out

    @staticmethod
    def nibbles(codes: np.ndarray) -> np.ndarray:
        """Two words to the byte."""
        return (codes[:, 0::2] << 4) | codes[:, 1::2]

    @staticmethod
    def from_nibbles(two: np.ndarray) -> np.ndarray:
        out = np.empty((len(two), two.shape[1] * 2), dtype=np.uint8)
        out[:, 0::2], out[:, 1::2] = two >> 4, two & 15
        return out
