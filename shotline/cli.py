"""Command line: ``python -m shotline.cli VIDEO [-o FILE] [-f FORMAT] [-s SENSITIVITY] [-q] [-v]``.

An unknown format is written as JSON, and a sensitivity of any other name counts as medium.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import __version__
from .options import SENSITIVITIES, Options
from .sinks import default_output, fixed_extension, format_result


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    parser = argparse.ArgumentParser(prog="shotline", description="Scene changes of a Y4M video.", exit_on_error=False)
    parser.add_argument("video", nargs="*")
    parser.add_argument("-o", "--output")
    parser.add_argument("-f", "--format", default="aegisub", help="json, csv, aegisub or txt, timecode or tc, edl")
    parser.add_argument("-s", "--sensitivity", default="medium", help=", ".join(SENSITIVITIES))
    parser.add_argument("-q", "--quiet", action="store_true")
    parser.add_argument("-v", "--verbose", action="store_true")
    parser.add_argument("--version", action="version", version=__version__)
    if not args:
        parser.print_help()
        return 0
    try:
        given, unknown = parser.parse_known_args(args)
    except argparse.ArgumentError as e:
        print(e, file=sys.stderr)
        return 1
    problem = f"unknown option {unknown[0]}" if unknown else "no video given" if not given.video else None if Path(given.video[-1]).exists() else f"no such file: {given.video[-1]}"
    if problem:
        print(problem, file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .plans import detect_scene_changes

    video = given.video[-1]
    output = fixed_extension(given.output or default_output(video, given.format), given.format)
    rule = "=" * 60
    if not given.quiet:
        print("\n".join(("Scene detection", rule, f"Input:  {Path(video).resolve()}", f"Size:   {Path(video).stat().st_size / 1048576:.2f} MB", f"Output: {Path(output).resolve()}", rule, "")))
    spark = SparkSession.builder.appName("shotline").getOrCreate()
    count = 0

    def scene(s: dict) -> None:
        nonlocal count
        count += 1
        if given.verbose:
            print(f"  Scene {count}: Frame {s['frameNumber']} at {s['timecode']}", flush=True)

    def progress(p: dict) -> None:
        if not given.verbose:
            eta = f" ETA: {p['eta']:.0f}s" if p["eta"] is not None else ""
            print(f"\rProgress: {p['percent']}% ({p['current_frame']}/{p['total_frames']}){eta}   ", end="", flush=True)

    calls = {} if given.quiet else {"on_scene": scene, "on_progress": progress}
    try:
        found = detect_scene_changes(spark, str(Path(video).resolve()), Options(sensitivity=given.sensitivity if given.sensitivity in SENSITIVITIES else "medium"), **calls)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    text = format_result(found, given.format)
    Path(output).write_text(text)
    if given.quiet:
        print(text)
    else:
        print()
        took = found["stats"]["processingTime"]
        print("\n".join((rule, "Complete!", rule, f"Scenes detected:  {len(found['scenes'])}", f"Processing time:  {took:.0f}s", f"Processing speed: {found['metadata']['totalFrames'] / took:.1f} fps", rule)))
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
