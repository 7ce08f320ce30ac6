"""Command line with the training-data queries: ``python -m tagloom.llm QUERY --data FOLDER``; options as of ``python -m tagloom``."""

from tagloom.__main__ import main
from tagloom.llm.queries import QUERIES as LLM_QUERIES
from tagloom.queries import QUERIES

if __name__ == "__main__":
    raise SystemExit(main(queries=QUERIES | LLM_QUERIES))
