"""python -m cladespark [-i SCRIPT] [-o OUTPUT] [--version] [--exit-codes]"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from cladespark import errors
from cladespark.plans.session import VERSION, Session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cladespark")
    parser.add_argument("-i", "--input", default="-", help="script, or - for the standard input")
    parser.add_argument("-o", "--output", default="-", help="where output goes, or - for the standard output")
    parser.add_argument("-v", "--version", action="store_true")
    parser.add_argument("--exit-codes", action="store_true")
    options = parser.parse_args(argv)
    if options.version:
        print(VERSION)
        return 0
    if options.exit_codes:
        for kind in (errors.InputError, errors.ParseError, errors.UnifyError, errors.ComputeError, errors.OutputError):
            print(kind.exit_code, kind.__name__)
        return 0
    from pyspark.sql import SparkSession

    try:
        text = sys.stdin.read() if options.input == "-" else Path(options.input).read_text()
    except OSError as e:
        print(f"error: {e}")
        return errors.InputError.exit_code
    lines: list[str] = []
    code = Session(SparkSession.builder.appName("cladespark").getOrCreate(), lines.append).main(text)
    out = "\n".join(lines) + "\n" if lines else ""
    if options.output == "-":
        print(out, end="")
    else:
        Path(options.output).write_text(out)
    return code


if __name__ == "__main__":
    sys.exit(main())
