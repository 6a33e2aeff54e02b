from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import kernels
from tidemark.streaming.indicators import live_indicators

SCHEMA = "symbol string, timeframe string, ts timestamp, close double, high double, volume double"


def test_stream_equals_batch_with_forming_and_late_bars(spark, tmp_path):
    x = np.random.default_rng(0).normal(100, 3, 60)
    t0 = datetime(2024, 1, 1)

    def bar(i, c):
        return ("s", "H1", t0 + timedelta(hours=i), float(c), float(c) + 1, 10.0)

    batches = []
    for i in range(0, 60, 10):
        forming = [bar(i, 1.0)] if i else []
        batches.append(forming)
        late = [bar(i - 5, 999.0)] if i else []
        batches.append([*late, *(bar(j, x[j]) for j in range(i, i + 10))])
    source, sink = tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate(b for b in batches if b):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/{k:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(source))
    seen = []
    query = live_indicators(stream).writeStream.outputMode("update").option("checkpointLocation", str(sink)).foreachBatch(lambda df, _: seen.extend(df.collect())).start()
    query.processAllAvailable()
    query.stop()
    last = {r.ts: r for r in seen}
    assert len(last) == 60 and not any(r.close == 999.0 for r in seen)
    ema, rsi = kernels.ema(x, 12), kernels.rsi(x, 14)
    fast = np.concatenate((np.full(14, np.nan), kernels.ema(x[14:], 12)))
    line = fast - kernels.ema(x, 26)
    for i, r in enumerate(last[t] for t in sorted(last)):
        for got, want in ((r.ema, ema[i]), (r.rsi, rsi[i]), (r.macd, line[i])):
            assert (got is None or got != got) if want != want else got == pytest.approx(want)
