"""Paged collectors as a Python data source: one partition for each query plan, a bounded and cycle-safe page loop (S8-S13, S17-S19, ST2, ST4)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "plan_id string, page int, item_id string, payload string, exclusion_reason string"
MAX_PAGES = 100


def exclusion(item: dict) -> str | None:
    """Why an item is left out of the corpus: no id, no text, deleted or removed."""
    text = (item.get("text") or "").strip()
    if not item.get("id"):
        return "missing_id"
    if not text:
        return "empty_text"
    return {"[deleted]": "deleted", "[removed]": "removed"}.get(text.lower())


class SourceUnavailable(Exception):
    """Raised by a fetch whose source cannot be read; code tells why."""

    def __init__(self, reason: str, code: str = "unavailable"):
        super().__init__(reason)
        self.code = code


@dataclass
class PlanRun:
    """How a plan's page loop ended: collected, partial, unavailable or failed, why, and what was left out."""

    status: str = "collected"
    error_code: str | None = None
    pages: int = 0
    items: int = 0
    excluded: dict[str, int] = field(default_factory=dict)


def pages(fetch: Callable[[str, str | None], tuple[list[dict], str | None]], plan: str, most: int = MAX_PAGES, run: PlanRun | None = None) -> Iterator[tuple[int, dict]]:
    """Items of a plan page by page until there is no cursor; run tells how it ended.

    A cursor that comes again, a page limit that is met with pages left, and an error after some items make the run partial; an error
    before any item makes it unavailable or failed. Nothing ends without a status.
    """
    run, cursor, seen = run or PlanRun(), None, set()

    def stop(status: str, code: str) -> None:
        run.status, run.error_code = "partial" if run.items else status, code

    while run.pages < most:
        if cursor in seen:
            return stop("failed", "cursor_cycle")
        seen.add(cursor)
        try:
            items, cursor = fetch(plan, cursor)
        except SourceUnavailable as e:
            return stop("unavailable", e.code)
        except (OSError, ValueError) as e:
            return stop("failed", type(e).__name__)
        for item in items:
            if why := exclusion(item):
                run.excluded[why] = run.excluded.get(why, 0) + 1
            else:
                run.items += 1
            yield run.pages, item
        run.pages += 1
        if not cursor:
            return None
    run.status, run.error_code = "partial", "page_limit"
    return None


class FixturePages(DataSource):
    """Offline stand-in of a paged web source: option pages is JSON {plan: [[items of page 1], ...]}."""

    @classmethod
    def name(cls) -> str:
        return "fixture_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FixtureReader(json.loads(self.options["pages"]), int(self.options.get("maxPages", MAX_PAGES)))


class FixtureReader(DataSourceReader):
    def __init__(self, plans: dict, most: int, status: bool = False):
        self.plans, self.most, self.status = plans, most, status

    def partitions(self):
        return [InputPartition(p) for p in sorted(self.plans)]

    def read(self, partition):
        plan = partition.value
        book = self.plans[plan]

        def fetch(_, cursor):
            at = int(cursor or 0)
            return book[at] if at < len(book) else [], str(at + 1) if at + 1 < len(book) else None

        run = PlanRun()
        for page, item in pages(fetch, plan, self.most, run):
            if not self.status:
                yield plan, page, str(item.get("id") or ""), json.dumps(item, ensure_ascii=False, sort_keys=True), exclusion(item)
        if self.status:
            yield plan, run.status, run.error_code, run.pages, run.items, run.excluded


class FixtureStatus(FixturePages):
    """One row for each plan of the same source: how its loop ended and how many items were left out by reason."""

    @classmethod
    def name(cls) -> str:
        return "fixture_status"

    def schema(self) -> str:
        return "plan_id string, status string, error_code string, pages int, items int, excluded map<string,int>"

    def reader(self, schema) -> DataSourceReader:
        return FixtureReader(json.loads(self.options["pages"]), int(self.options.get("maxPages", MAX_PAGES)), True)
