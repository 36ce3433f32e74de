"""An engine object: a configuration with hooks, validators and counters around the functions on DataFrames."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from docloom.config import DEFAULT, Config
from docloom.errors import CLOSED, CONCURRENCY_LIMIT, JsonError
from docloom.functions import columns, interp, values
from docloom.operators import batch, security, validate
from docloom.plans.path import parse


class Hook(Protocol):
    """Sees an operation before and after it; before may raise to refuse it."""

    def before(self, op: str, path: str) -> None: ...

    def after(self, op: str, path: str, error: Exception | None, seconds: float) -> None: ...


@dataclass
class Engine:
    """Column operations under one configuration. It holds nothing but references to frames that Spark keeps for `parsed`."""

    config: Config = DEFAULT
    hooks: list[Hook] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    times: dict[str, list[float]] = field(default_factory=dict)  # by operation: runs, and seconds in all, least and most
    hits: int = 0
    misses: int = 0
    _kept: dict[tuple, tuple[DataFrame, DataFrame, float]] = field(default_factory=dict, repr=False)
    _running: int = field(default=0, repr=False)
    _closed: bool = field(default=False, repr=False)
    _changed: threading.Condition = field(default_factory=threading.Condition, repr=False)

    def _planned(self, op: str, path: str, f: Callable[[], Any]) -> Any:
        began, done, error = time.perf_counter(), [], None
        try:
            for h in self.hooks:
                h.before(op, path)
                done.append(h)
            self.counts[op] = self.counts.get(op, 0) + 1
            return f()
        except Exception as e:
            error = e
            raise
        finally:
            self._timed(op, time.perf_counter() - began)
            for h in reversed(done):
                h.after(op, path, error, time.perf_counter() - began)

    def _timed(self, op: str, seconds: float) -> None:
        n, total, least, most = self.times.get(op, [0, 0.0, seconds, seconds])
        self.times[op] = [n + 1, total + seconds, min(least, seconds), max(most, seconds)]

    def metrics(self) -> dict[str, dict[str, float]]:
        """Runs and average, least and most seconds of each operation, and how often `parsed` found a kept frame."""
        out = {op: {"runs": n, "average": total / n, "least": least, "most": most} for op, (n, total, least, most) in self.times.items()}
        asked = self.hits + self.misses
        return out | {"kept": {"hits": self.hits, "misses": self.misses, "ratio": self.hits / asked if asked else 0.0, "frames": len(self._kept)}}

    def parsed(self, df: DataFrame, doc: str, name: str = "v") -> DataFrame:
        """df with the VARIANT of a document under `name`, which Spark keeps in memory or on disk: until clear_cache, keep_seconds
        or most_kept newer ones. A frame of an equal plan gets the kept one."""
        key, now = (df.semanticHash(), doc, name), time.monotonic()
        for k in [k for k, (_, _, at) in self._kept.items() if now - at > self.config.keep_seconds]:
            self._drop(k)
        if key in self._kept and self._kept[key][0].sameSemantics(df):
            self.hits += 1
            self._kept[key] = self._kept.pop(key)  # the last to go
            return self._kept[key][1]
        self.misses += 1
        new = df.withColumn(name, columns.variant(self._checked(doc)))
        if not self.config.most_kept:
            return new
        self._drop(key)
        while len(self._kept) >= self.config.most_kept:
            self._drop(next(iter(self._kept)))
        self._kept[key] = (df, new.persist(StorageLevel.MEMORY_AND_DISK), now)
        return new

    def _drop(self, key: tuple) -> None:
        if key in self._kept:
            self._kept.pop(key)[1].unpersist()

    def clear_cache(self) -> None:
        """Let go of all kept frames; those in use are computed again."""
        for k in list(self._kept):
            self._drop(k)

    def run(self, action: Callable[[], Any]) -> Any:
        """An action, such as a count, as one of most_running at once at most; beyond these, and after close, a JsonError."""
        with self._changed:
            if self._closed:
                raise JsonError(CLOSED, "the engine is closed", "run")
            if self._running >= self.config.most_running:
                raise JsonError(CONCURRENCY_LIMIT, f"{self._running} actions are running", "run")
            self._running += 1
        began = time.perf_counter()
        try:
            return action()
        finally:
            with self._changed:
                self._running -= 1
                self._timed("run", time.perf_counter() - began)
                self._changed.notify_all()

    def close(self, seconds: float = 30.0) -> bool:
        """Refuse new actions, wait for the running ones, and clear the cache. Whether all ended in time."""
        with self._changed:
            self._closed = True
            ended = self._changed.wait_for(lambda: not self._running, seconds)
        self.clear_cache()
        return ended

    def _checked(self, doc: Column | str) -> Column:
        """The document where all validators (functions from a Column to a boolean Column) agree, else NULL."""
        c = F.col(doc) if isinstance(doc, str) else doc
        for v in self.config.validators:
            c = F.when(v(c), c)
        return c

    def get(self, doc: Column | str, path: str) -> Column:
        return self._planned("get", path, lambda: columns.json_get(self._checked(doc), path, self.config))

    def get_typed(self, doc: Column | str, path: str, to: str, default: Any = None) -> Column:
        return self._planned("get", path, lambda: columns.json_get_typed(self._checked(doc), path, to, default, self.config))

    def get_all(self, doc: Column | str, paths: Mapping[str, tuple[str, str]]) -> Column:
        return self._planned("get", ",".join(p for p, _ in paths.values()), lambda: columns.json_get_all(self._checked(doc), paths, self.config))

    def safe_get(self, doc: Column | str, path: str) -> Column:
        return self._planned("get", path, lambda: columns.safe_get(self._checked(doc), path, self.config))

    def set(self, doc: Column | str, path: str, value: Any) -> Column:
        return self._planned("set", path, lambda: columns.json_set(self._checked(doc), path, value, self.config))

    def set_create(self, doc: Column | str, path: str, value: Any) -> Column:
        return self._planned("set", path, lambda: columns.json_set(self._checked(doc), path, value, self.config.but(create_paths=True)))

    def delete(self, doc: Column | str, path: str, clean: bool = False) -> Column:
        f = columns.json_delete_clean if clean else columns.json_delete
        return self._planned("delete", path, lambda: f(self._checked(doc), path, self.config))

    def validate(self, doc: Column | str, schema: validate.Schema) -> Column:
        return self._planned("validate", "", lambda: validate.json_validate(self._checked(doc), schema, self.config))

    def encode(self, doc: Column | str) -> Column:
        return self._planned("encode", "", lambda: columns.json_encode(self._checked(doc), self.config))

    def input_error(self, doc: Column | str) -> Column:
        return self._planned("validate", "", lambda: security.json_input_error(doc, self.config))

    def process(self, df: DataFrame) -> DataFrame:
        return self._planned("batch", "", lambda: batch.process_batch(df, self.config))

    def observed(self, df: DataFrame, doc: str, name: str = "documents") -> tuple[DataFrame, Observation]:
        """df, and an observation of rows, bytes and invalid documents that fills as df is run."""
        seen = Observation(name)
        c = F.col(doc)
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(c)).alias("bytes"), F.count_if(F.try_parse_json(c).isNull()).alias("invalid")), seen


def get_value(text: str, path: str, config: Config = DEFAULT) -> Any:
    """One document on the driver: the value at a path; raises JsonError."""
    return interp.get(values.loads(text, config), parse(path, config))


def set_text(text: str, path: str, value: Any, config: Config = DEFAULT) -> str:
    return values.dumps(interp.set_value(values.loads(text, config), parse(path, config), value, config), config.encode)


def delete_text(text: str, path: str, config: Config = DEFAULT) -> str:
    return values.dumps(interp.delete(values.loads(text, config), parse(path, config), config), config.encode)


def merge_texts(texts: list[str], mode: str = values.UNION) -> str:
    """Two documents or more, from left to right."""
    if len(texts) < 2:
        raise JsonError("TYPE_MISMATCH", "at least two documents merge", "merge")
    out = values.loads(texts[0])
    for t in texts[1:]:
        out = values.merge(out, values.loads(t), mode)
    return values.dumps(out)
