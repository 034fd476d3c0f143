"""What operators leave in the shared folder: the tables that results read, and no others."""

import os

from tessera.llm.common import CLEANUP, shared_dir
from tessera.llm.lines import dedup_lines
from tessera.llm.simhash import one_of_each


def tables(spark):
    places = os.walk(shared_dir(spark).removeprefix("file:"))
    return {os.path.join(at, d) for at, inside, _ in places for d in inside if d.startswith(("rdd-", "table-"))}


def test_tables_made_on_the_way_are_deleted(spark, docs):
    rows = [(i, f"one line that is everywhere\nanother line with number {i} and more\nread {i}", "s") for i in range(20)]
    for made in (dedup_lines, one_of_each):
        before, mode = tables(spark), spark.conf.get(CLEANUP)
        out = made(docs(rows))
        assert len(tables(spark) - before) == 1 and spark.conf.get(CLEANUP) == mode
        assert out.count() == out.count() == len(out.collect()) > 0
