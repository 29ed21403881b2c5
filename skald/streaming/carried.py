"""Scene-to-scene state of a stream: the same rows as ``operators.carried.carry``, one micro-batch after another.

The state of an export is its last scene, its latest scenes, and for each
character the latest scenes with it; only what a batch touches is read and
written.  It lives in the checkpoint, so a restarted query goes on where the
last one ended.  Scenes of an export come in ascending order from batch to
batch (within one they are sorted); a scene at or before the last one is a
repeat and gives nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.carried import ENTRY, SHOWN_SCENES

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Carry(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "scene long, characters string, authors string, latest string")
        self.seen = handle.getMapState("seen", "name string", "entries string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).drop_duplicates("scene").sort_values("scene", kind="stable")
        scene, characters, authors, latest = None, [], {}, []
        if self.last.exists():
            held = self.last.get()
            scene, characters, authors, latest = held[0], json.loads(held[1]), json.loads(held[2]), json.loads(held[3])
        seen: dict[str, list] = {}
        out = []
        for row in pdf.itertuples(index=False):
            if scene is not None and row.scene <= scene:
                continue
            own = [c for c in (row.characters if row.characters is not None else [])]
            names = list(dict.fromkeys(c.strip(" ").lower() for c in own if c is not None and c.strip(" ")))
            for name in names:
                if name not in seen:
                    seen[name] = json.loads(self.seen.getValue((name,))[0]) if self.seen.containsKey((name,)) else []
            shared = sorted({tuple(e) for name in names for e in seen[name]}, key=lambda e: e[0])[-self.most :]
            context = shared if names else latest
            out.append((key[0], row.scene, characters, authors, [{"scene": s, "narrative": n} for s, n in context]))
            entry = [row.scene, row.narrative]
            for name in names:
                seen[name] = [*seen[name], entry][-self.most :]
            scene, characters, authors, latest = row.scene, own, dict(row.authors or {}), [*latest, entry][-self.most :]
        if scene is not None:
            self.last.update((int(scene), json.dumps(characters), json.dumps(authors), json.dumps(latest, default=int)))
        for name, entries in seen.items():
            self.seen.updateValue((name,), (json.dumps(entries, default=int),))
        yield pd.DataFrame(out, columns=["export", "scene", "previous_characters", "previous_authors", "context"])

    def close(self) -> None:
        pass


def carry_stream(scenes: DataFrame, most: int = SHOWN_SCENES) -> DataFrame:
    """The rows of ``carry`` for a stream of scenes(export, scene long, characters, authors, narrative)."""
    spark = scenes.sparkSession
    spark.conf.set(_STATE_STORE, _ROCKS)  # the only store that holds map state
    given = scenes.where("export is not null and scene is not null").select("export", "scene", "characters", "authors", "narrative")
    kind = dict(given.dtypes)
    out = f"export {kind['export']}, scene long, previous_characters array<string>, previous_authors map<string,string>, context array<{ENTRY.format(scene='long')}>"
    return given.groupBy("export").transformWithStateInPandas(_Carry(most), out, "Append", "None")
