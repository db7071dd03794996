from __future__ import annotations

from shoalspark.sources.io import (FRAMES, FRAMES_WITHOUT_META, bad_file_names, read_frames, read_table, with_file_metadata,
                                   write_table)

HEADER = "time,frame,olf_x,olf_y,speed_mm_per_sec,distance_mm,cue_side,treatment,fish_replicate\n"


def test_read_folder_and_nulls(spark, tmp_path):
    a = tmp_path / "a"
    a.mkdir()
    (a / "one.csv").write_text(HEADER + "00:01.00,0,0.5,NA,NaN,1.5,Right,C8AHL,1\n")
    (a / "two.csv").write_text(HEADER + "00:02.00,1,NA,0.1,2.5,1.5,Left,C8AHL,2\n")
    (a / "notes.txt").write_text("not a table")
    rows = {r["fish_replicate"]: r for r in read_frames(spark, str(a)).collect()}
    assert len(rows) == 2 and rows["1"]["olf_y"] is None and rows["1"]["speed_mm_per_sec"] is None
    assert rows["2"]["olf_x"] is None and rows["2"]["distance_mm"] == 1.5


def test_several_folders_with_missing_columns(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    (a / "one.csv").write_text(HEADER + "00:01.00,0,0.5,0.2,1.0,1.5,Right,C8AHL,1\n")
    (b / "two.csv").write_text("frame,time,fish_replicate\n7,00:03.00,9\n")
    rows = {r["fish_replicate"]: r for r in read_frames(spark, [str(a), str(b)]).collect()}
    assert rows["9"]["frame"] == 7 and rows["9"]["olf_x"] is None and rows["1"]["olf_x"] == 0.5


def test_file_name_metadata(spark, tmp_path):
    head = "time,frame,olf_x,olf_y,speed_mm_per_sec,distance_mm\n"
    (tmp_path / "zebra_e1_C8AHL_Right_3_poseData.csv").write_text(head + "00:01.00,0,0.5,0.2,1.0,1.5\n")
    (tmp_path / "zebra_e1_C8AHL_Right_poseData.csv").write_text(head + "00:01.00,0,0.5,0.2,1.0,1.5\n")
    (tmp_path / "zebra_e1_C8DMS0_Left_4.csv").write_text(head + "00:01.00,0,0.5,0.2,1.0,1.5\n")
    df = read_frames(spark, str(tmp_path), FRAMES_WITHOUT_META)
    got = {(r["species"], r["treatment"], r["cue_side"], r["fish_replicate"]) for r in with_file_metadata(df).collect()}
    assert got == {("zebra", "C8AHL", "Right", "3"), (None, None, None, None), ("zebra", "C8DMS0", "Left", "4")}
    bad = bad_file_names(df).collect()
    assert [(r["source_file"], r["rows"]) for r in bad] == [("zebra_e1_C8AHL_Right_poseData.csv", 1)]


def test_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 2.5), ("2", None)], "fish string, m1 double")
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        write_table(df, path, fmt)
        back = read_table(spark, path, df.schema, fmt)
        assert back.columns == df.columns
        assert sorted(map(tuple, back.collect())) == [("1", 2.5), ("2", None)]
    assert FRAMES.fieldNames()[0] == "time"
