"""The best rows of each query, kept while a task streams its batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Candidate rows that a task gathers before it drops all but the best.
GATHERED = 200_000
#: Scores of queries and nodes that a task works out at once.
PIECE = 1_000_000


class RunningTop:
    """The ``k`` best (score, then smallest id) of each of ``n`` queries over all batches fed to it.

    What a task holds and sends on is ``n`` times ``k`` rows, however many rows it reads.
    """

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.parts, self.rows = k, np.full(n, -np.inf), [], 0

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: one row for each of ``queries`` (numbers below n), one column for each of ``ids``; -inf is no score."""
        if not scores.size:
            return
        least = self.floor[queries]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        # equal scores stay until ids decide
        row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        self.parts.append(pd.DataFrame({"q": queries[row], "id": ids[column], "score": scores[row, column]}))
        self.rows += len(row)
        if self.rows > GATHERED:
            self.shrink()

    def shrink(self) -> pd.DataFrame:
        all_ = pd.concat(self.parts, ignore_index=True) if self.parts else pd.DataFrame({"q": [], "id": [], "score": []})
        best = all_.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q", sort=False).head(self.k)
        full = best.groupby("q")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index.to_numpy(dtype=np.int64)] = full["min"].to_numpy(dtype=np.float64)
        self.parts, self.rows = [best], 0
        return best


def pieces(batch: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """Parts of a batch of which ``width`` numbers a row are at most about ``PIECE``; none for no row or no width."""
    size = max(1, PIECE // max(1, width))
    for i in range(0, len(batch) if width else 0, size):
        yield batch.iloc[i : i + size]
