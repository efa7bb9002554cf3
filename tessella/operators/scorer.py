"""The boundary to a model: a scorer maps (qid, prompt, candidates) to candidate scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "qid bigint, candidate string, position int, logprob_sum double, n_tokens int"
#: (prompt, candidates) -> (log-probability sum, tokens) of each candidate.
Score = Callable[[str, list[str]], list[tuple[float, int]]]


def apply_scorer(requests: DataFrame, make: Callable[[], Score]) -> DataFrame:
    """Runs a scorer over requests (qid, prompt, candidates); make() builds it once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for b in batches:
            rows = []
            for qid, prompt, cands in zip(b["qid"], b["prompt"], b["candidates"]):
                names = list(cands) if cands is not None else []
                for k, (c, (lp, n)) in enumerate(zip(names, score(prompt, names))):
                    rows.append((qid, c, k, lp, n))
            yield pd.DataFrame(rows, columns=["qid", "candidate", "position", "logprob_sum", "n_tokens"])

    return requests.select("qid", "prompt", "candidates").mapInPandas(run, SCHEMA)


def overlap_score() -> Score:
    """A scorer without a model: shared words with the prompt, as a log-probability."""
    from math import log

    def score(prompt: str, candidates: list[str]) -> list[tuple[float, int]]:
        known = set((prompt or "").lower().split())
        return [(log((1 + sum(w in known for w in c.lower().split())) / (2 + len(c.split()))), max(1, len(c.split()))) for c in candidates]

    return score


def precomputed(predictions: DataFrame) -> DataFrame:
    """The default scorer: best and second scores of a prediction table, one row per candidate."""
    both = F.array(F.struct(F.col("chosen_variant").alias("candidate"), F.col("best_score").alias("s")), F.struct(F.lit("").alias("candidate"), F.col("second_score").alias("s")))
    return predictions.filter("best_score is not null").select("pred_id", "qid", F.posexplode(both).alias("position", "c")).select("pred_id", "qid", F.col("c.candidate").alias("candidate"), "position", F.col("c.s").alias("logprob_sum"), F.lit(1).alias("n_tokens"))
