"""Order-dependent folds over groups of any size, holding only the fold's state in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, types as T


def ordered_fold(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    columns: Sequence[str],
    start: Callable[[], Any],
    add: Callable[[Any, tuple], Iterable[tuple] | None],
    close: Callable[[Any], list[tuple]],
    schema: T.StructType,
) -> DataFrame:
    """Read each key's rows in order; `add(state, row)` updates the state and may emit rows, and
    `close(state)` emits the last ones. Emitted rows are prefixed by the key.

    Spark partitions by key and sorts (spilling as needed); a key's rows stream through as Arrow
    batches, so a long key costs time in its task but not memory.
    """
    fields = list(columns)
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, opened = None, None, False
        for batch in batches:
            done: list[tuple] = []
            values = zip(*[batch[c] for c in fields])
            for k, row in zip(batch[key], values):
                if not opened or not (k == current or (pd.isna(k) and pd.isna(current))):
                    if opened:
                        done.extend((current, *out) for out in close(state))
                    current, state, opened = k, start(), True
                made = add(state, row)
                if made:
                    done.extend((current, *out) for out in made)
            if done:
                yield pd.DataFrame(done, columns=names)
        if opened:
            rest = [(current, *out) for out in close(state)]
            if rest:
                yield pd.DataFrame(rest, columns=names)

    wanted = [key, *[c for c in df.columns if c in set(fields) | set(order)]]
    ranged = df.select(*wanted).repartition(key).sortWithinPartitions(key, *order)
    return ranged.mapInPandas(run, schema)
