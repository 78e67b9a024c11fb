import json

from pyspark.sql import functions as F

from panelkit.catalog import PanelSpec
from panelkit.operators import panel
from panelkit.plans.model import RecordModel
from panelkit.streaming import online

CHANNELS = ("Temp", "HR", "Resp", "WBC")
SCHEMA = "who string, h double, Temp double, HR double, Resp double, WBC double, y int"


def run(stream, name, spark, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_state_equals_batch_vectors(spark, tmp_path):
    rows = []
    for e in range(4):
        for h in range(12):
            rows.append((f"p{e}", float(h), 36.0 + h / 10 if (h + e) % 3 else None, 80.0 + h if h % 4 == 0 else None,
                         20.0 + h if h % 5 == 1 else None, None, int(e < 2 and h == 6 + e)))
    mixed = sorted(rows, key=lambda r: (int(r[1]) * 7 + int(r[0][1])) % 13)
    source = tmp_path / "in"
    source.mkdir()
    for i in range(4):
        part = mixed[i::4]
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(
            ("who", "h", *CHANNELS, "y"), r))) for r in part))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    seen = run(online.current_vectors(stream, "who", "h", CHANNELS, "y", lateness=1000), "state_out", spark, "update")
    batch = panel.patient_vector(spark.createDataFrame(rows, SCHEMA), PanelSpec("who", "h", "y", CHANNELS))
    final = {r["who"]: r for r in seen.collect()}  # the memory sink appends in batch order
    for want in batch.collect():
        got = final[want["who"]]
        assert all(got[c] == want[c] for c in (*CHANNELS, "SIRS", "y"))


def write(folder, name, rows, columns):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(columns, r))) for r in rows))


def start(stream, out, checkpoint):
    """Everything there is to read from where the checkpoint ended; rows go to ``out``."""
    q = (stream.writeStream.outputMode("update").option("checkpointLocation", str(checkpoint))
         .foreachBatch(lambda rows, _: rows.write.mode("append").parquet(str(out)))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def test_late_and_repeated_rows_and_a_restart(spark, tmp_path):
    """Shuffled, late and repeated rows over two runs from one checkpoint equal the batch vectors at each end."""
    columns = ("who", "h", *CHANNELS, "y")
    rows = [("a", 5.0, 38.5, None, None, None, 0), ("a", 3.0, 37.0, 80.0, None, None, 0),
            ("a", 4.0, 37.5, None, 20.0, None, 0), ("a", 5.0, 38.5, None, None, None, 0),
            ("b", 1.0, 36.0, 70.0, 15.0, 9.0, 0), ("b", 9.0, 39.0, None, None, None, 0)]
    more = [("b", 8.0, 38.8, None, None, None, 1), ("a", 6.0, None, 95.0, None, None, 0), ("a", 4.5, 36.1, None, 22.0, None, 0)]
    source, checkpoint = tmp_path / "in", tmp_path / "checkpoint"
    spec = PanelSpec("who", "h", "y", CHANNELS)
    for i, part in enumerate((rows, more)):
        write(source, f"{i}.json", part, columns)
        stream = spark.readStream.schema(SCHEMA).json(str(source))
        start(online.current_vectors(stream, "who", "h", CHANNELS, "y"), tmp_path / f"out_{i}", checkpoint)
        got = {r["who"]: r for r in spark.read.parquet(str(tmp_path / f"out_{i}")).collect()}
        known = spark.createDataFrame((rows + more) if i else rows, SCHEMA).dropDuplicates(["who", "h"])
        want = {r["who"]: r for r in panel.patient_vector(known, spec).collect()}
        assert got.keys() == want.keys()
        assert all(got[w][c] == want[w][c] for w in got for c in (*CHANNELS, "SIRS", "y"))


def test_only_touched_channels_are_rewritten(spark, tmp_path):
    columns = ("who", "h", *CHANNELS, "y")
    source, checkpoint = tmp_path / "in", tmp_path / "checkpoint"
    parts = ([("a", 1.0, 37.0, 80.0, 18.0, 9.0, 0)], [("a", 2.0, 38.0, None, None, None, 0)])
    for i, part in enumerate(parts):
        write(source, f"{i}.json", part, columns)
        stream = spark.readStream.schema(SCHEMA).json(str(source))
        q = start(online.current_vectors(stream, "who", "h", CHANNELS, "y"), tmp_path / f"out_{i}", checkpoint)
    # One map entry of the touched channel and the course; the other three channels' entries are not written.
    assert q.lastProgress["stateOperators"][0]["numRowsUpdated"] <= 3
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] >= 6


def test_values_before_the_horizon_are_forgotten(spark, tmp_path):
    columns = ("who", "h", *CHANNELS, "y")
    source, checkpoint = tmp_path / "in", tmp_path / "checkpoint"
    totals = []
    for h in range(12):
        write(source, f"{h}.json", [("a", float(h), 36.0 + h / 10, None, None, None, 0)], columns)
        stream = spark.readStream.schema(SCHEMA).json(str(source))
        q = start(online.current_vectors(stream, "who", "h", CHANNELS, "y", lateness=3), tmp_path / f"out_{h}", checkpoint)
        totals.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(totals) == totals[-1] == totals[6]


def test_discharge_by_event_time(spark, tmp_path):
    """A stay's state goes once the watermark passes its last row; rows behind the watermark change nothing."""
    columns = ("who", "t", "h", *CHANNELS, "y")
    schema = "who string, t timestamp, " + SCHEMA.split(", ", 1)[1]
    time = lambda hour: f"2024-01-01T{hour:02d}:00:00"
    parts = ([("a", time(1), 1.0, 37.0, 80.0, None, None, 0), ("b", time(2), 1.0, 36.5, None, None, None, 0)],
             [("b", time(9), 8.0, 39.0, None, None, None, 0)],
             [("a", time(1), 1.0, 41.0, None, None, None, 1), ("b", time(10), 9.0, 39.5, None, None, None, 0)],
             [("a", time(12), 1.0, 36.0, None, None, None, 0)])
    source, checkpoint, totals = tmp_path / "in", tmp_path / "checkpoint", []
    for i, part in enumerate(parts):
        write(source, f"{i}.json", part, columns)
        stream = spark.readStream.schema(schema).json(str(source))
        q = start(online.current_vectors(stream, "who", "h", CHANNELS, "y", event_time="t"), tmp_path / f"out_{i}", checkpoint)
        totals.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    # The late positive row of the discharged stay is dropped, and its next stay starts from nothing.
    late = {r["who"]: r for r in spark.read.parquet(str(tmp_path / "out_2")).collect()}
    assert "a" not in late and late["b"]["Temp"] == 39.5
    again = {r["who"]: r for r in spark.read.parquet(str(tmp_path / "out_3")).collect()}
    assert again["a"]["Temp"] == 36.0 and again["a"]["HR"] is None and again["a"]["y"] == 0


def test_json_records_are_scored_alike_in_stream_and_batch(spark, tmp_path):
    bodies = [{"vitals": {"Temp": 39.5, "Resp": 28}}, {"vitals": {"Temp": None, "pH": 9.0}}]
    (tmp_path / "a.txt").write_text("\n".join(map(json.dumps, bodies)))
    model = RecordModel()
    batch = online.score_stream(spark.read.text(str(tmp_path)), model, ["value"])
    got = run(online.score_stream(spark.readStream.schema("value string").text(str(tmp_path)), model, ["value"]),
              "scored", spark, "append")
    plain = lambda d: d.select("value", "prediction_probability", F.to_json("warnings").alias("w"), F.to_json("shap_waterfall").alias("s"))
    assert got.count() == 2 and plain(got).exceptAll(plain(batch)).isEmpty()


def test_repeated_rows_are_dropped(spark, tmp_path):
    line = json.dumps({"who": "p", "h": 1.0, "t": "2024-01-01T00:00:00"})
    (tmp_path / "a.json").write_text(line + "\n" + line)
    stream = spark.readStream.schema("who string, h double, t timestamp").json(str(tmp_path))
    assert run(online.drop_repeats(stream, "t", ["who", "h"]), "once", spark, "append").count() == 1
