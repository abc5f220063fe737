"""`python -m tidemark metrics DIR` prints the metric suite; `python -m tidemark query SQL` runs SQL over the configured sources."""

from __future__ import annotations

import sys

from . import config
from .engine import Engine
from .errors import ConfigError
from .operators.metrics import run_suite
from .session import session
from .streaming.changes import ChangeListener


def main(args: list[str]) -> int:
    if len(args) == 2 and args[0] == "metrics":
        for name, df in run_suite(session(), args[1]).items():
            print(name)
            df.show(truncate=False)
        return 0
    if len(args) == 2 and args[0] == "query":
        try:
            settings = config.load()
        except ConfigError as e:
            print(f"configuration: {e}", file=sys.stderr)
            return 2
        engine = Engine.configured(session(), settings)
        ChangeListener(settings.cdc_path).sync(engine.cache)
        engine.query(args[1]).show(truncate=False)
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
