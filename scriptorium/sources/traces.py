"""Traces of questions: a bounded queue before a daily JSON-lines file, dropping when full, never failing."""

from __future__ import annotations

import json
import os
import queue
import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

TRACE = "traceId string, question string, timestampUtc timestamp, stages array<struct<name:string,start:timestamp,end:timestamp,durationMs:double>>, candidateRfcNumbers array<int>, answerGenerated boolean, warningCount int"


class TraceSink:
    def __init__(self, directory: str, size: int = 256) -> None:
        self.directory, self.dropped = directory, 0
        self.waiting: queue.Queue = queue.Queue(size)
        self.worker = threading.Thread(target=self._drain, daemon=True)
        self.worker.start()

    def put(self, record: dict) -> bool:
        try:
            self.waiting.put_nowait(record)
            return True
        except queue.Full:
            self.dropped += 1
            return False

    def _drain(self) -> None:
        while True:
            record = self.waiting.get()
            if record is None:
                return
            try:
                os.makedirs(self.directory, exist_ok=True)
                day = datetime.now(timezone.utc).strftime("%Y-%m-%d")
                with open(os.path.join(self.directory, f"traces-{day}.jsonl"), "a", encoding="utf-8") as file:
                    file.write(json.dumps(record, default=lambda x: x.isoformat() if hasattr(x, "isoformat") else str(x)) + "\n")
            except OSError:
                self.dropped += 1

    def close(self) -> None:
        self.waiting.put(None)
        self.worker.join(10)


def write_traces(traces: DataFrame, directory: str) -> int:
    """Put the traces of a batch into the daily file, one by one through the bounded queue; returns how many were dropped."""
    sink = TraceSink(directory)
    for row in traces.toLocalIterator():
        sink.put(row.asDict(recursive=True))
    sink.close()
    return sink.dropped


def read_traces(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(TRACE).json(directory)
