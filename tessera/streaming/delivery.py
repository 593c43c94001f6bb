"""Delayed delivery on streams: writes wait, by target graph, until a tick reaches them."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

INPUT = "target_graph string, ord bigint, kind string, payload string, deliver_at bigint, fidelity double, tick bigint"
OUTPUT = "target_graph string, payload string, deliver_at bigint, fidelity double, delivered_at bigint"

#: Writes that an entry of the state holds, and rows that a frame of the result holds, at most.
CHUNK = 5_000
FRAME = 50_000


class Delivery(StatefulProcessor):
    """Per target graph: chunks of waiting writes by due tick, each known by its first due tick and a running number.

    Rows of a batch apply in the order of `ord`.  A tick releases all that is due, by
    due tick, then arrival; nothing is ever dropped.  What waits is put away in chunks,
    and a tick opens those that begin by then only, so no write is touched for another's sake
    but the rest of a chunk.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "deliver_at bigint, part bigint", "writes string")
        self.parts = handle.getValueState("parts", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat([r.drop(columns="target_graph") for r in rows]).sort_values("ord", kind="stable")
        part = self.parts.get()[0] if self.parts.exists() else 0
        ticks, at = (batch["kind"] != "write").to_numpy().nonzero()[0].tolist(), 0
        for end in [*ticks, len(batch)]:
            writes = batch.iloc[at:end].sort_values("deliver_at", kind="stable")
            columns = [writes["deliver_at"].astype("int64").tolist(), writes["payload"].tolist(), writes["fidelity"].astype(float).tolist()]
            for k in range(0, len(writes), CHUNK):
                self._put([c[k : k + CHUNK] for c in columns], part)
                part += 1
            at = end + 1
            if end < len(batch):
                yield from self._release(key[0], int(batch["tick"].iat[end]))
        self.parts.update((part,))

    def _put(self, writes: list[list], part: int) -> None:
        """Columns due, payload, fidelity, sorted by due tick."""
        self.waiting.updateValue((writes[0][0], part), (json.dumps(writes),))

    def _release(self, graph: str, tick: int) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for first, part in sorted((int(k[0]), int(k[1])) for k in self.waiting.keys() if k[0] <= tick):
            writes = json.loads(self.waiting.getValue((first, part))[0])
            self.waiting.removeKey((first, part))
            upto = bisect_right(writes[0], tick)
            if upto < len(writes[0]):
                self._put([c[upto:] for c in writes], part)
            out += [(due, part, k, payload, fidelity) for k, (due, payload, fidelity) in enumerate(zip(*[c[:upto] for c in writes]))]
        out.sort(key=lambda w: w[:3])
        for k in range(0, len(out), FRAME):
            due, _, _, payload, fidelity = zip(*out[k : k + FRAME])
            yield pd.DataFrame({"target_graph": graph, "payload": payload, "deliver_at": due, "fidelity": fidelity, "delivered_at": tick})

    def close(self) -> None:
        pass


def deliver(rows: DataFrame) -> DataFrame:
    """Released writes (OUTPUT) of a stream of writes and ticks (INPUT).  Needs the RocksDB state store."""
    return rows.groupBy("target_graph").transformWithStateInPandas(Delivery(), OUTPUT, "Append", "None")
