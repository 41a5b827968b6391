"""Keep a store up to date with JSON dumps that arrive in a folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Store
from ..ingest import ingest_json


def stream_id(store: Store, checkpoint: str) -> str:
    """The name that a stream keeps when it is started anew from its checkpoint."""
    path = store.spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    stream = path.getFileSystem(store.spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(store.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def ingest_batch(store: Store, paths: list[str], stream: str, number: int) -> bool:
    """Ingest the dumps of a batch once: its number is published with its rows, and a batch that runs again is left out."""
    with store.transaction() as after:
        if store.registered_batch(stream) >= number:
            return False
        ingest_json(store, paths)
        after.streams[stream] = number
    return True


def follow_dumps(store: Store, folder: str, checkpoint: str) -> StreamingQuery:
    """Ingest the dumps that appear in ``folder``, all of a batch at once and exactly once, whatever fails in between."""

    def step(batch: DataFrame, number: int) -> None:
        paths = sorted(row["path"] for row in batch.select("path").distinct().collect())  # names of files, not their rows
        if paths:
            ingest_batch(store, paths, stream_id(store, checkpoint), number)

    # of the files only their names are read here
    kinds = "path string, modificationTime timestamp, length long, content binary"
    files = store.spark.readStream.format("binaryFile").schema(kinds).load(folder).select("path")
    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
