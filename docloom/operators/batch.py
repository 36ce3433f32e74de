"""Operations that come as rows: what to do to which document, one result or error for each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULT, Config
from docloom.errors import JsonError
from docloom.functions import interp, values
from docloom.functions.columns import safe_get
from docloom.plans.path import parse


def process_batch(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """df (op, doc, path, value) with `result` and `error`. op is get, set, delete or validate; value is JSON text. Rows fail alone,
    with the code of their error, and a row of another op with UNKNOWN_OPERATION."""

    def run(op: pd.Series, doc: pd.Series, path: pd.Series, value: pd.Series) -> pd.DataFrame:
        rows = []
        for o, d, p, v in zip(op, doc, path, value, strict=True):
            try:
                root = values.loads(d, config)
                if o == "get":
                    rows.append((values.dumps(interp.get(root, parse(p or "", config))), None))
                elif o == "set":
                    rows.append((values.dumps(interp.set_value(root, parse(p or "", config), values.loads(v, config), config)), None))
                elif o == "delete":
                    rows.append((values.dumps(interp.delete(root, parse(p or "", config), config)), None))
                elif o == "validate":
                    rows.append(("true", None))
                else:
                    rows.append((None, "UNKNOWN_OPERATION"))
            except JsonError as e:
                rows.append((None, e.code))
        return pd.DataFrame(rows, columns=["result", "error"], dtype=object)

    done = F.pandas_udf(run, returnType="struct<result: string, error: string>")
    return df.withColumn("_r", done("op", "doc", "path", "value")).select(*[c for c in df.columns if c not in ("result", "error")], "_r.result", "_r.error")


def warmup(df: DataFrame, doc: str, paths: list[str], config: Config = DEFAULT) -> DataFrame:
    """(path, n, found, failed): how often each path can be read; the documents stay persisted for what comes next if the caller
    persisted them."""
    each = F.array(*[F.struct(F.lit(p).alias("path"), safe_get(doc, p, config)["exists"].alias("ok")) for p in paths])
    rows = df.select(F.explode(each).alias("r")).select("r.*")
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("found"), F.count_if(~F.col("ok")).alias("failed"))
