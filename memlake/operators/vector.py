"""Semantic deduplication inside small requests. Searches are in ``ann``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

def greedy_dedup(items: DataFrame, threshold: float = 0.85) -> DataFrame:
    """request_id, ordinal, source, priority, embedding -> kept, duplicate_of, position. Inside a request: by falling priority, an item goes if it is as near to a kept one; items without vectors stay, last. Requests are small by their caps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["priority", "ordinal"], ascending=[False, True], kind="stable").reset_index(drop=True)
        kept: list[tuple[int, np.ndarray]] = []
        out, bare = [], []
        for r in pdf.itertuples():
            v = None if r.embedding is None or len(r.embedding) == 0 else np.asarray(r.embedding, float)
            if v is None:
                bare.append(r)
                continue
            near = None
            for o, w in kept:
                n = np.linalg.norm(v) * np.linalg.norm(w) if len(v) == len(w) else 0
                if n and float(v @ w) / n >= threshold:
                    near = o
                    break
            if near is None:
                kept.append((r.ordinal, v))
            out.append((r.request_id, r.ordinal, near is None, near, len(kept) if near is None else None))
        out += [(r.request_id, r.ordinal, True, None, len(kept) + k + 1) for k, r in enumerate(bare)]
        frame = pd.DataFrame(out, columns=["request_id", "ordinal", "kept", "duplicate_of", "position"])
        return frame.astype({"duplicate_of": "Int64", "position": "Int64"})

    return items.groupBy("request_id").applyInPandas(run, "request_id long, ordinal long, kept boolean, duplicate_of long, position long")
