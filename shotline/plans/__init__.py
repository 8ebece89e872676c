"""Whole queries: detection from frames to scenes."""

from .detect import detect, detect_files, detect_scene_changes, progress, result, scenes_of

__all__ = ["detect", "detect_files", "detect_scene_changes", "progress", "result", "scenes_of"]
