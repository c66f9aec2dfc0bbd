"""``python -m gridloom --array_path PATH`` prints an array's values."""

from __future__ import annotations

import argparse
import sys

import numpy as np

from .operators.array import Array


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom")
    parser.add_argument("--array_path", required=True)
    try:
        array = Array.open(parser.parse_args(args).array_path)
        print(np.array2string(array.read(), threshold=sys.maxsize))
    except Exception as e:  # noqa: BLE001
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
