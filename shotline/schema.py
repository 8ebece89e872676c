"""Schemas of the tables that the engine reads and makes."""

from __future__ import annotations

from pyspark.sql import types as T

RESOLUTION = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])
VIDEOS = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("total_frames", T.LongType()), T.StructField("duration", T.DoubleType()), T.StructField("fps", T.DoubleType()), T.StructField("resolution", RESOLUTION)])
FRAMES = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("frame_number", T.LongType()), T.StructField("pts", T.DoubleType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("stride", T.IntegerType()), T.StructField("data", T.BinaryType())])
PAIR_SCORES = "video_id string, frame_number long, intra_key int, ssad_score int"
BLOCKS = "video_id string, frame_number long, mb_x int, mb_y int, mv struct<x:int,y:int>, sad16 int, dev int"
SCENES = "video_id string, frame_number long, timestamp double, timecode string, confidence double"
