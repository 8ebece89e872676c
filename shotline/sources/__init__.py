"""Video sources: Y4M and raw gray files, PGM image sequences, frame tables, and files that a decoder program reads."""

from .decoded import decoded_files, read_decoded
from .scored import ScoreSource, read_scores, stream_scores
from .video import ChosenFrameSource, FrameSource, VideoSource, extract_frame, frames_where, read_frame_table, read_frames, read_pgm, read_videos, register, stream_frames

__all__ = ["ChosenFrameSource", "FrameSource", "ScoreSource", "VideoSource", "decoded_files", "extract_frame", "frames_where", "read_decoded", "read_frame_table", "read_frames", "read_pgm", "read_scores", "read_videos", "register", "stream_frames", "stream_scores"]
