"""The ingest of memories as a stream: each new memory against what is stored of its user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.matching import Stored


def sequential(incoming: DataFrame, block: list[str], key: str, text: str, title: str) -> DataFrame:
    """(block, key, decision, match) of a stream of memories: ``sequential_dedup`` batch by batch. A block's stored
    memories are its state, a map by their place in the order in which they were stored; a batch writes those that it
    adds or changes. Memories of a batch are taken in order of their key; batches should be, too."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Sequential(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getMapState("stored", "place long", "id long, head string, body string")

        def handleInputRows(self, k, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            had = [v for _, v in sorted(self.state.iterator())] if self.state.exists() else []
            stored = Stored(had)
            new = sorted(((int(i), h or "", b or "") for x in rows for i, h, b in x.iloc[:, :3].itertuples(index=False)), key=lambda r: r[0])
            out = [(*k, i, *stored.take(i, head, body)) for i, head, body in new]
            for place, (i, head, body) in enumerate(stored.rows):
                if place >= len(had) or (head, body) != tuple(had[place][1:]):
                    self.state.updateValue((place,), (i, head, body))
            yield pd.DataFrame(out, columns=[*block, key, "decision", "match"], dtype=object)

        def close(self) -> None:
            pass

    kinds = dict(incoming.dtypes)
    shape = ", ".join([*(f"{b} {kinds[b]}" for b in block), f"{key} {kinds[key]}", "decision string", "match long"])
    return incoming.select(key, title, text, *block).groupBy(*block).transformWithStateInPandas(Sequential(), shape, "append", "None")
