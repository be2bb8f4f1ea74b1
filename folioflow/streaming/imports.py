"""Imports as a stream: what is created and what exists already, decided across micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioflow.operators.ingest import dedup_key

#: The state store that transformWithState needs, and its setting.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _seen(days: int | None) -> StatefulProcessor:
    """A processor that holds for each key that it was seen, with a lifetime if days are given, after which a link is new again.

    The class is made here so that it travels to the workers whole.
    """

    class Seen(StatefulProcessor):
        lifetime = days * 86_400_000 if days else None

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.place = handle.getValueState("place", "place long", self.lifetime)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  as Spark names them
            new = not self.place.exists()
            # the numbers of the key's links in this micro-batch
            places = pd.concat([batch["place"] for batch in rows]).sort_values(ignore_index=True)
            outcome = pd.Series("existing", index=places.index)
            if new:
                outcome[0] = "created"
                self.place.update((int(places[0]),))
            yield pd.DataFrame({"place": places, "key": key[0], "outcome": outcome})

        def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
            self.place.update((-1,))

        def close(self) -> None:
            pass

    return Seen()


def outcomes(links: DataFrame, existing: DataFrame | None = None, days: int | None = None) -> DataFrame:
    """place, key, outcome of a stream of admitted links, as ingest.outcomes gives for all at once.

    The first link of a key is created: that of the smallest place in the first micro-batch
    that has the key; all others exist by then, in whatever batch or run of the stream
    they come. existing (a column key; only read when the stream begins) says what the
    library has. The session's state store must be PROVIDER.
    """
    key = dedup_key(F.col("platform"), F.col("platform_id"), F.col("canonical_url"))
    keyed = links.select("place", F.when(F.col("reject_reason").isNull(), key).alias("key"))
    known = existing.select("key").where("key is not null").distinct().groupBy("key") if existing is not None else None
    decided = keyed.where("key is not null").groupBy("key").transformWithStateInPandas(
        _seen(days), "place long, key string, outcome string", "Append", "ProcessingTime" if days else "None", initialState=known
    )
    return decided.unionByName(keyed.where("key is null").withColumn("outcome", F.lit("rejected")))
