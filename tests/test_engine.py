import json
import os
import shutil
import subprocess
import sys
import tracemalloc
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from shotline import cli, queries, sinks
from shotline.functions import scalars as S
from shotline.operators.fold import fold_cuts
from shotline.operators.pairs import _score_chunks, pair_frames, score_frames, score_pairs, scores_of, validate
from shotline.options import Options
from shotline.plans import detect, detect_scene_changes
from shotline.schema import FRAMES
from shotline.sources import decoded_files, extract_frame, read_decoded, read_frames, read_pgm, read_videos
from shotline.streaming import stream_cuts

from . import model

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in cur.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_text_operators(tmp_path, pipeline):
    """A copy without their folders, with and without the pipeline's file, imports and has the other queries."""
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "shotline", tmp_path / "shotline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e._shots.QUERIES), set(e.oracle_sql()) <= set(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", "True"], done.stderr


def clip(n=14, h=96, w=112, seed=0):
    rng = np.random.default_rng(seed)
    out, base = [], None
    for k in range(n):
        if k % 5 == 0:
            base = np.kron(rng.integers(40, 220, (h // 8, w // 8), dtype=np.uint8), np.ones((8, 8), np.uint8))
        out.append(np.roll(base, k % 5, axis=1))
    return np.stack(out)


def frame_rows(pictures, video="v"):
    return [(video, k, k / 25, p.shape[1], p.shape[0], p.shape[1], bytearray(p.tobytes())) for k, p in enumerate(pictures)]


def expected(pictures, skip=0, code=4):
    kept = list(range(0, len(pictures), skip + 1))
    return [(b, *model.score(pictures[a], pictures[b], code)[1:]) for a, b in zip(kept, kept[1:], strict=False)]


@pytest.mark.parametrize("skip", [0, 2])
@pytest.mark.parametrize("chunk", [1, 3 * 96 * 112, 1 << 24])
def test_chunks_do_not_change_scores(spark, skip, chunk):
    pictures = clip()
    frames = spark.createDataFrame(frame_rows(pictures) + frame_rows(pictures[::-1], "w"), FRAMES).repartition(3)
    got = score_frames(frames, skip=skip, chunk_bytes=chunk).collect()
    for video, own in (("v", pictures), ("w", pictures[::-1])):
        assert sorted((r["frame_number"], r["intra_key"], r["ssad_score"]) for r in got if r["video_id"] == video) == expected(own, skip)
    paired = score_pairs(pair_frames(frames, skip)).collect()
    assert sorted(map(tuple, paired)) == sorted(map(tuple, got))


def test_scenes_end_to_end(spark):
    pictures = clip()
    frames = spark.createDataFrame(frame_rows(pictures), FRAMES)
    scenes = detect(frames).orderBy("frame_number").collect()
    assert [r["frame_number"] for r in scenes] == [0, *model.cuts(expected(pictures))]
    assert scenes[1]["timecode"].startswith("00:00:00.") and scenes[1]["confidence"] is None
    low = detect(frames, options=Options(extended=True, intra_thresh=10**6, intra_thresh2=10**6)).collect()
    assert len(low) == 1
    smooth = detect(frames, options=Options(extended=True, smoothing_window=3, smoothing_min=3)).collect()
    assert len(smooth) <= len(scenes)


def test_bad_frames_fail_with_a_reason(spark):
    good = frame_rows(clip(3))
    for bad, told in (((*good[1][:6], bytearray(b"x")), "short"), ((*good[1][:6], bytearray()), "empty"), ((*good[1][:3], 0, 96, 0, good[1][6]), "dimensions")):
        with pytest.raises(Exception, match=told):
            validate(spark.createDataFrame([good[0], bad], FRAMES)).collect()
    with pytest.raises(Exception, match="gaps"):
        score_frames(spark.createDataFrame([good[0], good[2]], FRAMES)).collect()
    with pytest.raises(Exception, match="differ in size"):
        score_frames(spark.createDataFrame([good[0], (*good[1][:3], 96, 96, 96, good[1][6])], FRAMES)).collect()


def test_fold_and_stream_agree(spark, tmp_path):
    rng = np.random.default_rng(4)
    scores = [(f"v{v}", n, None if rng.random() < 0.1 else int(rng.integers(0, 4000)), int(rng.integers(0, 260))) for v in range(3) for n in range(1, 120)]
    want = {(v, n) for v in ("v0", "v1", "v2") for n in model.cuts([(n, k, s) for x, n, k, s in scores if x == v])}
    df = spark.createDataFrame(scores, "video_id string, frame_number long, intra_key int, ssad_score int")
    assert {tuple(r) for r in fold_cuts(df).collect()} == want
    for part in range(3):
        df.filter((F.col("frame_number") - 1) % 120 >= part * 40).filter(F.col("frame_number") - 1 < part * 40 + 40).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_cuts(stream).writeStream.format("memory").queryName("cuts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("cuts").collect()} == want


def y4m(path, pictures, fps="24000:1001"):
    n, h, w = pictures.shape
    chroma = bytes(2 * ((w + 1) // 2) * ((h + 1) // 2))
    path.write_bytes(f"YUV4MPEG2 W{w} H{h} F{fps} C420jpeg\n".encode() + b"".join(b"FRAME\n" + p.tobytes() + chroma for p in pictures) + b"FRAME\npart")


def test_sources(spark, tmp_path):
    pictures = clip()
    y4m(tmp_path / "a.y4m", pictures)
    (tmp_path / "a.gray").write_bytes(pictures.tobytes())
    frames = read_frames(spark, str(tmp_path / "a.y4m"))
    assert [bytes(r["data"]) for r in frames.orderBy("frame_number").collect()] == [p.tobytes() for p in pictures]
    assert frames.filter("frame_number = 3").first()["pts"] == pytest.approx(3 * 1001 / 24000)
    assert [r["frame_number"] for r in extract_frame(spark, str(tmp_path / "a.y4m"), 5).collect()] == [5] and extract_frame(spark, str(tmp_path / "a.y4m"), 99).count() == 0
    raw = read_frames(spark, str(tmp_path / "a.gray"), width=112, height=96, fps=25, skipFrames=3)
    assert sorted(r["frame_number"] for r in raw.collect()) == [0, 4, 8, 12]
    meta = read_videos(spark, str(tmp_path / "a.y4m")).first()
    assert meta["total_frames"] == 14 and tuple(meta["resolution"]) == (112, 96)
    with pytest.raises(Exception, match="no video stream"):
        read_videos(spark, str(tmp_path / "a.gray")).collect()
    for k, p in enumerate(pictures[:3]):
        (tmp_path / f"i{k:03d}.pgm").write_bytes(b"P5\n112 96\n255\n" + p.tobytes())
    assert [bytes(r["data"]) for r in read_pgm(spark, f"{tmp_path}/i*.pgm", 25, "i").orderBy("frame_number").collect()] == [p.tobytes() for p in pictures[:3]]


def test_y4m_headers(spark, tmp_path):
    y4m(tmp_path / "zero.y4m", clip(3), "0:0")
    assert read_videos(spark, str(tmp_path / "zero.y4m")).first()["fps"] == 30
    whole = (tmp_path / "zero.y4m").read_bytes()
    (tmp_path / "odd.y4m").write_bytes(whole.replace(b"FRAME\n", b"FRAME Ip\n", 1))
    with pytest.raises(Exception, match="frame header"):
        read_frames(spark, str(tmp_path / "odd.y4m")).collect()


def test_file_to_text(spark, tmp_path, monkeypatch, capsys):
    pictures = clip()
    y4m(tmp_path / "a.y4m", pictures, "25:1")
    told, moved = [], []
    found = detect_scene_changes(spark, str(tmp_path / "a.y4m"), on_scene=told.append, on_progress=moved.append)
    numbers = [0, *model.cuts(expected(pictures))]
    assert [s["frameNumber"] for s in found["scenes"]] == numbers and [s["frameNumber"] for s in told] == numbers[1:] and moved[0]["percent"] == 0
    assert sinks.format_result(found, "txt") == "# keyframe format v1\nfps 25\n" + "".join(f"{n}\n" for n in numbers)
    assert sinks.format_result(found, "csv").splitlines()[1] == "0,0,00:00:00.000"
    assert set(json.loads(sinks.format_result(found, "?"))) == {"scenes", "metadata", "stats"}
    assert sinks.format_result(found, "tc").startswith("00:00:00.000\n") and "001  AX" in sinks.format_result(found, "edl")
    assert sinks.default_output("/x/clip.y4m", "aegisub") == "clip_keyframes.txt" and sinks.fixed_extension("a.json.json", "csv") == "a.csv.json"
    monkeypatch.chdir(tmp_path)
    assert cli.main([]) == 0 and cli.main(["nothing.y4m"]) == 1 and cli.main(["--bad", "a.y4m"]) == 1
    assert cli.main(["a.y4m", "-f", "csv", "-q"]) == 0 and (tmp_path / "a_keyframes.csv").exists() and "frame,timestamp,timecode" in capsys.readouterr().out


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    code = lambda s: one(S.timecode(F.lit(float(s))))
    assert [code(0), code(143 / (24000 / 1001)), code(360000.25)] == ["00:00:00.000", "00:00:05.964", "100:00:00.250"]
    rates = {"30000/1001": 30000 / 1001, "25/1": 25.0, "25": 25.0}
    assert {t: one(S.parse_fps(F.lit(t))) for t in rates} == rates and np.isnan(one(S.parse_fps(F.lit("0/0")))) and one(S.parse_fps(F.lit("x"))) is None
    numbers = [0.0, 0.04, 5.964291666666667, 3.333333333333333e-4, 12345678.5, 100.0]
    assert [one(S.js_number(F.lit(x))) for x in numbers] == [sinks.number_text(x) for x in numbers] == ["0", "0.04", "5.964291666666667", "0.0003333333333333333", "12345678.5", "100"]
    assert one(S.eta(F.lit(0), F.lit(10), F.lit(1.0))) is None and one(S.percent(F.lit(1), F.lit(200))) == 1
    with pytest.raises(ValueError, match="sensitivity"):
        Options(sensitivity="none")
    S.register(spark)
    assert spark.sql("SELECT shot_timecode(1.5D), shot_threshold(1)").first() == ("00:00:01.500", 3215)


def test_sql_names_equal_the_columns(spark):
    S.register(spark)
    rows = spark.range(0, 40).withColumns({"n": F.col("id").cast("int"), "e": F.col("id") / 7})
    same = [("shot_score_threshold(n)", S.adaptive_score(F.col("n"), 90)), ("shot_threshold(n)", S.adaptive_intra(F.col("n"), 2000)), ("shot_percent(id, 39)", S.percent(F.col("id"), F.lit(39))), ("shot_eta(id, 50, e)", S.eta(F.col("id"), F.lit(50), F.col("e"))), ("shot_megabytes(id * 99999)", S.megabytes(F.col("id") * 99999)), ("shot_timecode(e * 1000)", S.timecode(F.col("e") * 1000))]
    for r in rows.select(*[F.struct(F.expr(a).alias("a"), b.alias("b")) for a, b in same]).collect():
        assert all(x.a == x.b for x in r)
    assert spark.sql("SELECT shot_is_cut(NULL, 300, 1), shot_is_cut(2001, 0, 50), shot_is_cut(2000, 90, 50)").first() == (True, True, False)


def test_detect_reads_frames_once(spark, tmp_path):
    y4m(tmp_path / "a.y4m", clip(), "25:1")
    path = str(tmp_path / "a.y4m")
    plan = detect(read_frames(spark, path), read_videos(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("BatchScan frames") == 1


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000])
def test_fold_over_blocks_of_steps(spark, n):
    rng = np.random.default_rng(n)
    scores = [("v", k, int(rng.integers(0, 4000)), int(rng.integers(0, 260)), k / 25) for k in range(1, n + 1)]
    df = spark.createDataFrame(scores, "video_id string, frame_number long, intra_key int, ssad_score int, pts double")
    got = fold_cuts(df, carry=("pts",)).collect()
    assert sorted(r["frame_number"] for r in got) == model.cuts([s[1:4] for s in scores]) and all(r["pts"] == r["frame_number"] / 25 for r in got)


def test_stream_holds_late_scores(spark, tmp_path):
    rng = np.random.default_rng(8)
    scores = [("v", n, int(rng.integers(0, 4000)), int(rng.integers(0, 260))) for n in range(2, 122, 2)]
    df = spark.createDataFrame(scores, "video_id string, frame_number long, intra_key int, ssad_score int")
    for part in (2, 0, 1, 0):  # the first third last but two, and once more
        df.filter(f"frame_number > {part * 40} AND frame_number <= {part * 40 + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_cuts(stream, skip=1).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["frame_number"] for r in spark.table("late").collect()) == model.cuts([s[1:] for s in scores])


def test_folders_patterns_and_commas(spark, tmp_path):
    for name in ("a,b.y4m", "c.y4m", "d.Y4M"):
        y4m(tmp_path / name, clip(2), "25:1")
    ids = lambda p: sorted(Path(r["video_id"]).name for r in read_videos(spark, p).collect())
    assert ids(str(tmp_path)) == ["a,b.y4m", "c.y4m", "d.Y4M"] and ids(f"{tmp_path}/*.y4m") == ["a,b.y4m", "c.y4m"]
    assert ids(f"{tmp_path}/a,b.y4m") == ["a,b.y4m"] and ids(f"{tmp_path}/c.y4m,{tmp_path}/d.Y4M") == ["c.y4m", "d.Y4M"] and ids(f"{tmp_path}/*.mov") == []
    whole = (tmp_path / "c.y4m").read_bytes()
    (tmp_path / "p.y4m").write_bytes(whole.replace(b"FRAME\n", b"FRAME Ip\n"))
    assert [bytes(r["data"]) for r in read_frames(spark, f"{tmp_path}/p.y4m").orderBy("frame_number").collect()] == [p.tobytes() for p in clip(2)]


def test_decoder_program(spark, tmp_path):
    """A program that writes Y4M stands for a decoder."""
    y4m(tmp_path / "a.bin", clip(), "25:1")
    (tmp_path / "decode.py").write_text("import sys; d = open(sys.argv[1], 'rb').read(); sys.stdout.buffer.write(d); sys.exit('no video' if d[:1] != b'Y' else 0)")
    program = f"{sys.executable} {tmp_path}/decode.py {{path}}"
    path = f"{tmp_path}/a.bin"
    want = [tuple(r)[1:] for r in read_frames(spark, path).orderBy("frame_number").collect()]
    assert [tuple(r)[1:] for r in read_decoded(spark, path, program).orderBy("frame_number").collect()] == want
    assert [r["frame_number"] for r in read_decoded(spark, path, program, skip=4).orderBy("frame_number").collect()] == [0, 5, 10]
    assert [r["frame_number"] for r in detect(read_decoded(spark, path, program), decoded_files(spark, path)).orderBy("frame_number").collect()] == [0, *model.cuts(expected(clip()))]
    (tmp_path / "x.bin").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no video"):
        read_decoded(spark, f"{tmp_path}/x.bin", program).collect()


def test_command_line_output(spark, tmp_path, monkeypatch, capsys):
    y4m(tmp_path / "a.y4m", clip(), "25:1")
    monkeypatch.chdir(tmp_path)
    assert cli.main(["a.y4m", "-v", "-s", "anything"]) == 0
    out = capsys.readouterr().out
    assert (tmp_path / "a_keyframes.txt").read_text().startswith("# keyframe format v1") and "MB" in out and "Scene 1: Frame" in out and "Scenes detected:" in out


def test_megabytes_round_ties_to_even(spark):
    """Event 131072 is the first whose megabytes of ``console_text`` lie on a tie; DuckDB's printf is the measure."""
    sizes = [131072 * k * 12345 for k in (1, 2, 3, 5, 7)] + [0, 1, 5243, 1048576 * 3 + 131072, 10**15, 2**53 + 131072]
    S.register(spark)
    rows = spark.createDataFrame([(s,) for s in sizes], "n long").select("n", S.megabytes(F.col("n")).alias("text"), F.expr("shot_megabytes(n)").alias("named")).collect()
    for n, text, named in rows:
        assert text == named == duckdb.execute("SELECT printf('%.2f', ? / CAST(1048576 AS DOUBLE))", [n]).fetchone()[0]
    assert spark.range(1).select(S.megabytes(F.lit(None).cast("long"))).first()[0] is None


def test_scoring_takes_bounded_memory(spark):
    """What the kernel holds goes by the padded picture, of which a small frame is the least part: 2,000 pairs of 64 by 64 took over 200 MB at once."""
    pictures = np.repeat(np.arange(2001) * 7 % 200, 64 * 64).astype(np.uint8).reshape(-1, 64, 64)
    tracemalloc.start()
    keys, scores = scores_of(pictures[1:], pictures[:-1], 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    steps = np.abs(np.diff(np.arange(2001) * 7 % 200))
    assert keys == (256 * steps).tolist() and scores == (1024 * steps // 89).tolist()
    assert peak < 100e6


def test_runs_of_rows_do_not_change_scores():
    """Videos of several sizes and chunks in one task, cut into batches at every place."""
    shapes, rows, want = {"a": (96, 112), "b": (64, 64), "c": (96, 112)}, [], []
    for video, (h, w) in shapes.items():
        pictures = clip(7, h, w, seed=len(rows))
        for k, p in enumerate(pictures):
            homes = [(k // 3, False)] + [(k // 3 + 1, True)] * (k % 3 == 2)
            rows += [(video, c, k, halo, w, h, w, p.tobytes()) for c, halo in homes]
        want += [(video, *e) for e in expected(pictures)]
    names = ["video_id", "chunk", "frame_number", "halo", "width", "height", "stride", "data"]
    table = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in sorted(rows)])
    for size in (1, 2, 5, len(rows)):
        got = [tuple(r.values()) for b in _score_chunks("medium", 1, False)(iter(table.combine_chunks().to_batches(size))) for r in b.to_pylist()]
        assert sorted(got) == want


@pytest.mark.parametrize("name", ["texture_video_scores", "texture_video_scenes"])
def test_pictures_are_made_beside_the_kernel(spark, name):
    """Tiles of 64 bytes are sorted and shuffled, not pictures of 25,600; one window, one Python worker a task."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    python, made = plan.index("MapInArrow"), plan.index("unhex(array_join(")
    assert python < made < plan.index("Exchange", python) and plan.count("InArrow") == 1 and plan.count("Window [") == 1


def test_flat_frames_are_made_beside_the_kernel(spark):
    """The window over events and the kernel run once; a frame is shuffled as one number and its bytes are made after that."""
    plan = queries.QUERIES["flat_video_scenes"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    python, made = plan.index("MapInArrow"), plan.index("unhex(repeat")
    assert python < made < plan.index("Exchange", python) and plan.count("InArrow") == 1 and plan.count("Window [") == 1 and "Join" not in plan


def test_blocks_pair_tiles_and_deal_pairs(spark):
    """The window pairs tiles of 64 bytes; pairs are dealt to all tasks, not to one a label, and pictures made there."""
    plan = queries.QUERIES["texture_blocks"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    python, made = plan.index("MapInArrow"), plan.index("unhex(array_join(")
    assert python < made < plan.index("Exchange", python) < plan.index("Window [") and plan.count("InArrow") == 1
    few = queries.QUERIES["texture_blocks"](spark, SF).select("video_id", F.spark_partition_id().alias("task")).distinct()
    assert few.select("task").distinct().count() > 10
