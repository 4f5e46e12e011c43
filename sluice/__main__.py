"""python -m sluice recipe.yml [-v name=value ...] [--timeout seconds]"""

from __future__ import annotations

import argparse

from sluice.plans import recipe
from sluice.session import session


def main() -> None:
    given = argparse.ArgumentParser(prog="sluice")
    given.add_argument("recipe")
    given.add_argument("-v", "--variable", action="append", default=[])
    given.add_argument("--timeout", type=float)
    given.add_argument("--master")
    got = given.parse_args()
    recipe.run(got.recipe, session(got.master), dict(v.split("=", 1) for v in got.variable), timeout=got.timeout).show()


if __name__ == "__main__":
    main()
