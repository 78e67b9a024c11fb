import pytest
from pyspark.sql import functions as F

from panelkit.operators import panel
from panelkit.plans import cohort as plans
from panelkit.sources import patient_files

HEAD = "ICULOS|HR|Temp|Resp|WBC|Lactate|BaseExcess|SepsisLabel"


def write(path, *lines, head=HEAD):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([head, *lines]) + "\n")


@pytest.fixture
def two_stays(tmp_path):
    """One stay whose label turns positive in its third hour, and one whose label never does."""
    write(tmp_path / "turns.psv", "5|88|37.4|19|9.1|2.2|NaN|0", "6|NaN|NaN|21|NaN|NaN|-1.5|0",
          "7|101|38.9|27|12.6|NaN|-2.5|1", "8|133|40.4|31|19.9|7.7|-9.0|1", "9|20|31.0|8|2.0|0.1|9.0|0")
    write(tmp_path / "stays.psv", "1|61|36.2|13|5.5|0.7|1.0|0", "4|64|NaN|14|NaN|0.9|NaN|0")
    return tmp_path


@pytest.mark.parametrize("limit", [patient_files.WHOLE_FILE_BYTES, 0])
def test_nothing_after_the_boundary_is_seen(spark, two_stays, limit):
    rows = {r["patient_id"]: r for r in plans.patient_cohort(
        spark, str(two_stays), whole_file_bytes=limit).collect()}
    assert len(rows) == 2
    s, c = rows["turns"], rows["stays"]
    assert (s["SepsisLabel"], s["Temp"], s["Resp"], s["BaseExcess"], s["Lactate"]) == (1, 38.9, 27, -2.5, 2.2)
    assert (c["SepsisLabel"], c["Temp"], c["Resp"], c["Lactate"]) == (0, 36.2, 14, 0.9)
    assert all(r[f] is None for r in rows.values() for f in ("Hct", "BUN", "pH", "FiO2"))


def test_nested_and_listed_folders(spark, tmp_path):
    write(tmp_path / "ward" / "one.psv", "3|66|36.4|12|5.9|0.8|-0.4|0")
    write(tmp_path / "unit" / "two.psv", "2|117|39.3|29|16.2|4.1|-3.3|1")
    parts = [str(tmp_path / "ward"), str(tmp_path / "unit")]
    for paths in (str(tmp_path), parts, [str(tmp_path), *parts]):
        got = plans.patient_cohort(spark, paths).collect()
        assert sorted(r["SepsisLabel"] for r in got) == [0, 1]


def test_headers_in_any_order_and_equal_stems(spark, tmp_path):
    write(tmp_path / "a" / "p1.psv", "37.5|81|0", head="Temp|HR|SepsisLabel")
    write(tmp_path / "b" / "p1.csv", '82,"36.5",0', ",NaN,0", head='HR,"Temp",SepsisLabel')
    write(tmp_path / "b" / "skipped.csv", "90,36", head="HR,Temp")
    got = {r["file_path"].rsplit("/", 2)[1]: r for r in plans.patient_cohort(spark, str(tmp_path)).collect()}
    assert len(got) == 2
    # Both files know Temp and HR, at different places; empty and NaN cells carry the last value.
    raw = patient_files.scan_panel(spark, str(tmp_path))
    last = panel.patient_vector(raw, patient_files.panel_spec()).select("file_path", "HR", "Temp").collect()
    values = {r["file_path"].rsplit("/", 2)[1]: (r["HR"], r["Temp"]) for r in last}
    assert values == {"a": (81.0, 37.5), "b": (82.0, 36.5)}
    every = patient_files.scan_panel(spark, str(tmp_path), channels=None, label=None)
    assert {"HR", "Temp", "SepsisLabel"} <= set(every.columns) and every.count() == 4


def test_ties_keep_file_order_and_unknown_hours_come_last(spark, tmp_path):
    write(tmp_path / "p.psv", "2|36.1|0", "NaN|36.9|0", "1|36.0|0", "2|36.2|0", head="ICULOS|Temp|SepsisLabel")
    rows = patient_files.scan_panel(spark, str(tmp_path)).orderBy("ord").select("Temp").collect()
    assert [r["Temp"] for r in rows] == [36.0, 36.1, 36.2, 36.9]


def test_files_above_the_limit_are_read_once_each(spark, tmp_path):
    write(tmp_path / "small.psv", "1|36.1|0", head="ICULOS|Temp|SepsisLabel")
    write(tmp_path / "large.psv", *[f"{i}|36.{i % 9}|0" for i in range(400)], head="ICULOS|Temp|SepsisLabel")
    mixed = patient_files.scan_panel(spark, str(tmp_path), whole_file_bytes=200)
    whole = patient_files.scan_panel(spark, str(tmp_path))
    a, b = (d.select("patient_id", "ICULOS", "Temp") for d in (mixed, whole))
    assert a.count() == b.count() == 401 and a.exceptAll(b).isEmpty()


def test_line_breaks_quotes_and_separators_inside_cells(spark, tmp_path):
    head = 'ICULOS,Note,Temp,"HR",SepsisLabel'
    write(tmp_path / "a" / "p 1 [x].csv", '1,"said ""ill"",', 'then slept",36.1,70,0', '2,"a,b",36.2,71,0', "",
          '3,,NaN,"72",1', head=head)
    write(tmp_path / "b" / "plain.csv", "1,x,37.1,80,0", "2,y,37.2", head=head)
    write(tmp_path / "c" / "other.csv", '39.5,"two', 'lines",4,0', head="Temp,Note,ICULOS,SepsisLabel")
    write(tmp_path / "d" / "p.psv", "5|38.1|0", head="ICULOS|Temp|SepsisLabel")
    for limit in (patient_files.WHOLE_FILE_BYTES, 0):
        rows = patient_files.scan_panel(spark, str(tmp_path), ("Temp", "HR"), label=None,
                                        whole_file_bytes=limit).orderBy("patient_id", "ord").collect()
        assert [(r["patient_id"], r["ICULOS"], r["Temp"], r["HR"]) for r in rows] == [
            ("other", 4, 39.5, None), ("p", 5, 38.1, None), ("p 1 [x]", 1, 36.1, 70), ("p 1 [x]", 2, 36.2, 71),
            ("p 1 [x]", 3, None, 72), ("plain", 1, 37.1, 80), ("plain", 2, 37.2, None)]
    groups = patient_files.layouts(spark, str(tmp_path))
    assert len(groups) == 3 and sorted(g.multiline for g in groups) == [False, True, True]


def test_large_files_are_split_without_a_shuffle_of_their_rows(spark, tmp_path):
    head = "ICULOS,HR,Temp,SepsisLabel"
    write(tmp_path / "large.csv", *[f"{i},{i % 50},36.{i % 9},0" for i in range(1, 3001)], head=head)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = patient_files.scan_panel(spark, str(tmp_path), ("HR", "Temp"), whole_file_bytes=100)
        assert rows.rdd.getNumPartitions() > 4
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        got = rows.orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["ICULOS"], r["HR"]) for r in got] == [(i, i % 50) for i in range(1, 3001)]


def test_no_input_and_nothing_usable(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        patient_files.scan_panel(spark, str(tmp_path))
    write(tmp_path / "p.csv", "90,36", head="HR,Temp")
    with pytest.raises(ValueError):
        patient_files.scan_panel(spark, str(tmp_path))


def test_blocks_change_nothing(spark, tmp_path):
    lines = [f"{i}|{'NaN' if i % 3 else 30 + i / 10}|{'NaN' if i % 7 else i}|0" for i in range(1, 60)]
    write(tmp_path / "p.psv", *lines, head="ICULOS|Temp|HR|SepsisLabel")
    rows = patient_files.scan_panel(spark, str(tmp_path), channels=("Temp", "HR"))
    one = patient_files.panel_spec(("Temp", "HR"))
    cut = rows.withColumn("block", F.floor(F.col("ICULOS") / 5))
    for back in (False, True):
        a = panel.locf(rows, one, backfill=back).drop("block", "ord")
        b = panel.locf(cut, one, backfill=back).drop("block", "ord")
        assert a.exceptAll(b).isEmpty() and a.count() == b.count() == 59
    blocked = patient_files.panel_spec(("Temp", "HR"))
    blocked = type(blocked)(blocked.entity, blocked.order, blocked.label, blocked.channels, "block")
    a, b = (panel.first_entities(cut, spec, 1).select("ICULOS", "Hour") for spec in (
        type(one)(one.entity, one.order, one.label, one.channels), blocked))
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() == 59


def test_paper_cohort_reaches_its_targets(spark, tmp_path):
    write(tmp_path / "hours.psv", "10|63|36.3|12|5.2|0.8|-0.2|0", "11|69|36.6|14|6.1|0.9|0.3|0",
          "12|99|38.7|25|12.2|2.9|-1.1|1", "13|112|39.6|30|17.4|3.8|-2.4|1")
    rows = plans.hourly_rows(spark, str(tmp_path), 1)
    from panelkit.operators.impute import ChainedImputer
    out = plans.paper_cohort(rows, 10, 8, "hourly_small", imputer=ChainedImputer(rows.columns[2:-1], 1))
    counts = {r["SepsisLabel"]: r["count"] for r in out.groupBy("SepsisLabel").count().collect()}
    assert set(counts) == {0, 1} and counts == {0: 10, 1: 7}
    assert all(v is not None for r in out.collect() for v in r)


def test_extract_of_first_files(spark, tmp_path):
    for i in range(4):
        write(tmp_path / f"p{i}.psv", f"1|36.{i}|0", f"2|37.{i}|0", head="ICULOS|Temp|SepsisLabel")
    got = plans.hour_extract(spark, str(tmp_path), n=3)
    assert got.count() == 6 and {r["patient_id"] for r in got.collect()} == {"p0", "p1", "p2"}
    assert sorted(r["Hour"] for r in got.collect()) == [1, 1, 1, 2, 2, 2]
    patient_files.write_extract(got, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 6


def test_sampling_files_is_exact_and_repeatable(spark, tmp_path):
    for i in range(12):
        write(tmp_path / f"p{i}.psv", "1|36.5|0", head="ICULOS|Temp|SepsisLabel")
    draw = lambda seed: {r["patient_id"] for r in patient_files.scan_panel(
        spark, str(tmp_path), max_files=5, seed=seed).collect()}
    assert len(draw(1)) == 5 and draw(1) == draw(1)


def test_union_by_name(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "id int, HR double"), spark.createDataFrame([(2, 3.0)], "id int, Temp double")
    out = {r["id"]: r for r in patient_files.union_panels([a, b]).collect()}
    assert out[1]["Temp"] is None and out[2]["HR"] is None
