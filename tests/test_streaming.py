import pytest
from pyspark.sql import functions as F

from cairnlog.functions import families
from cairnlog.operators import records
from cairnlog.sources.lines import read_lines
from cairnlog.streaming import tail


def drain_stream(df, folder, mode="append"):
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(f"{folder}/out")


def test_tail_gives_whole_lines_and_goes_on(spark, tmp_path):
    log = tmp_path / "x.log"
    log.write_bytes(b"one\ntwo\r\nthr")
    got = drain_stream(tail.tail(spark, str(log)), tmp_path / "s")
    assert [r.text for r in got.orderBy("byte_start").collect()] == ["one", "two"]
    with log.open("ab") as f:
        f.write(b"ee\n\nfour")
    got = drain_stream(tail.tail(spark, str(log)), tmp_path / "s")
    assert [r.text for r in got.orderBy("byte_start").collect()] == ["one", "two", "three", ""]


def test_chunks_share_no_line(tmp_path, monkeypatch):
    log = tmp_path / "x.log"
    log.write_text("".join(f"line {i}\n" for i in range(100)))
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(tail, "CHUNK", size)
        r = tail.TailReader({"path": str(log)})
        parts = r.partitions(r.initialOffset(), r.latestOffset())
        assert [x[2] for p in parts for x in r.read(p)] == [f"line {i}" for i in range(100)]


def test_shrinking_is_an_error(tmp_path):
    log = tmp_path / "x.log"
    log.write_text("a\nb\n")
    r = tail.TailReader({"path": str(log)})
    r.latestOffset()
    log.write_text("a\n")
    with pytest.raises(ValueError):
        r.latestOffset()


LOG = "pre\n2024-01-01 00:00:05 a\n  more\n2024-02-30 00:00:00 bad\n  lost\n2024-01-01 00:00:01 back\n  end\n"


def headers(df):
    f = families.BY_NAME["ISO-8601"]
    h = F.length(families.matched(F.col("text"), f)) > 0
    ms = families.time_of(F.col("text"), f)
    return df.withColumn("is_header", h).withColumn("header_ms", F.when(h, ms)).withColumn("header_state", F.when(h, F.when(ms.isNotNull(), "explicit").otherwise("invalid")))


def test_record_states_equal_a_batch_at_every_cut(spark, tmp_path):
    (tmp_path / "all.log").write_text(LOG)
    batch = records.record_state(headers(read_lines(spark, str(tmp_path / "all.log"))), ["doc_id"])
    want = [(r.owner_ms, r.provenance) for r in batch.orderBy("line_no").collect()]
    for cut in (5, 40):
        log = tmp_path / f"{cut}.log"
        log.write_text(LOG[:cut])
        drain_stream(tail.record_states(headers(tail.tail(spark, str(log)))), tmp_path / f"s{cut}")
        log.write_text(LOG)
        got = drain_stream(tail.record_states(headers(tail.tail(spark, str(log)))), tmp_path / f"s{cut}")
        assert [(r.owner_ms, r.provenance) for r in got.orderBy("byte_start").collect()] == want
