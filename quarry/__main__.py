"""``python -m quarry``: list the named queries, run one, or list the cases of an evaluation."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from quarry.operators import evaluation
from quarry.plans import registry
from quarry.session import local_session


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarry")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="list the named queries")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name", choices=sorted(registry.QUERIES))
    run.add_argument("folder")
    run.add_argument("--out", help="folder to write the result to, as Parquet; else its first rows are shown")
    run.add_argument("--rows", type=int, default=20)
    cases = commands.add_parser("cases", help="list the cases of an evaluation")
    cases.add_argument("dataset")
    cases.add_argument("--case")
    cases.add_argument("--category")
    given = parser.parse_args(arguments)
    if given.command == "queries":
        print("\n".join(sorted(registry.QUERIES)))
    elif given.command == "cases":
        chosen = evaluation.chosen_cases(evaluation.checked_dataset(json.loads(Path(given.dataset).read_text())), given.case, given.category)
        print("\n".join(f"{n}. {c['id']} [{c['category']}] {c['query']}" for n, c in enumerate(chosen, 1)))
    else:
        result = registry.QUERIES[given.name](local_session(), given.folder)
        if given.out:
            result.write.mode("overwrite").parquet(given.out)
        else:
            result.show(given.rows, truncate=False)


if __name__ == "__main__":
    main()
