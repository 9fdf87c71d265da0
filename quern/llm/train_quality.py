"""Fits the profiles of quality.py: python -m quern.llm.train_quality FOLDER_OF_TABLES.

It reads a bounded sample, the SAMPLE documents of smallest id, and their labels in models/kinds.txt (kind, then the ids of that kind;
all others are prose). Labels are of whole documents; which of a document's lines are prose all the same is found by turns:
every line goes to the nearest profile of prose or of its document's kind, and the profiles become the means of their lines.
"""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np

from quern.llm import quality

#: Documents that the profiles are fitted on at most, profiles of each kind, and turns.
SAMPLE = 8_000
PROFILES = {"prose": 30, "list": 16, "table": 18, "junk": 24}
TURNS = 12


def labels() -> dict[int, str]:
    out = {}
    for row in (quality.MODELS / "kinds.txt").read_text().split("\n"):
        kind, *ids = row.split()
        out |= dict.fromkeys(map(int, ids), kind)
    return out


def fit(rows: np.ndarray, docs: np.ndarray, kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    names = np.array([quality.KINDS.index(k) for k in kinds])[docs]
    table, of = [], []
    for k, kind in enumerate(quality.KINDS):
        own = rows[names == k]
        own = own[rng.permutation(len(own))[:6000]]
        # far apart to begin with
        chosen = [own.mean(0)]
        far = quality.divergence(own, np.array(chosen))[:, 0]
        while len(chosen) < PROFILES[kind]:
            chosen.append(own[rng.choice(len(own), p=far / far.sum())])
            far = np.minimum(far, quality.divergence(own, chosen[-1][None, :])[:, 0])
        table += chosen
        of += [k] * len(chosen)
    table, of = np.array(table, np.float32), np.array(of)
    for _ in range(TURNS):
        d = quality.divergence(rows, table)
        d[(of[None, :] != names[:, None]) & (of[None, :] != 0)] = np.inf
        place = d.argmin(1)
        for j in range(len(table)):
            own = rows[place == j]
            if len(own):
                table[j] = own.mean(0)
    used = np.bincount(place, minlength=len(table)) > 0
    return table[used], of[used]


def main(folder: str) -> None:
    import pyarrow as pa
    import pyarrow.parquet as pq

    documents = pq.read_table(Path(folder) / "documents.parquet", columns=["doc_id", "text"]).to_pandas().sort_values("doc_id").dropna()
    known = labels()
    kinds = [known.get(i, "prose") for i in documents.doc_id]
    n = int((documents.doc_id <= documents.doc_id.iloc[: SAMPLE].max()).sum())
    m = quality.Measured(pa.array(documents.text.iloc[:n], pa.string()))
    table, of = fit(m.distributions(), m.doc, kinds[:n])
    np.savez_compressed(quality.MODELS / "profiles.npz", profiles=table.astype(np.float32), kinds=of)
    quality.profiles.cache_clear()
    got = m.verdicts(quality.nearest(m.distributions()))
    wrong = [k for k in range(n) if got[k] is not None and got[k] != kinds[k]]
    print("profiles", np.bincount(of), "documents", n, "unlike their labels", len(wrong), [int(documents.doc_id.iloc[k]) for k in wrong[:20]])


if __name__ == "__main__":
    main(sys.argv[1])
