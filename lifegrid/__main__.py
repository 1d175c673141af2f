"""python -m lifegrid inspect FILE: the profile of a table as JSON."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lifegrid")
    sub = p.add_subparsers(dest="command", required=True)
    inspect = sub.add_parser("inspect", help="print the profile of a table as JSON")
    inspect.add_argument("path")
    inspect.add_argument("--approximate", action="store_true", help="distinct counts by sketches")
    args = p.parse_args(argv)
    from .errors import UserInputError
    from .operators.profile import profile
    from .session import session
    from .sources.readers import load

    try:
        print(json.dumps(profile(load(session(), args.path), approximate=args.approximate), default=str))
    except UserInputError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
