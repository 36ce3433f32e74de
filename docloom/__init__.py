"""A PySpark-native engine for JSON documents in DataFrames."""

from docloom.config import DEFAULT, PRETTY, SECURE, Config, EncodeConfig
from docloom.engine import Engine, delete_text, get_value, merge_texts, set_text
from docloom.errors import JsonError, Missing
from docloom.functions.columns import (
    html_escape,
    json_apply,
    json_clean,
    json_compact,
    json_delete,
    json_delete_clean,
    json_encode,
    json_equal,
    json_exists,
    json_fields,
    json_get,
    json_get_all,
    json_get_typed,
    json_is_empty,
    json_is_null,
    json_merge,
    json_pretty,
    json_set,
    json_set_many,
    json_to_array,
    json_valid,
    native_extract,
    native_get,
    native_merge,
    native_pick,
    native_put,
    native_remove,
    native_slice,
    native_typed,
    safe_get,
    variant,
)
from docloom.functions.encode import Field, encode_batch, encode_record, encode_stream, rfc3339
from docloom.functions.record import from_value, to_value
from docloom.operators.validate import Schema, json_validate

__all__ = [
    "DEFAULT", "PRETTY", "SECURE", "Config", "EncodeConfig", "Engine", "JsonError", "Missing", "Schema",
    "delete_text", "get_value", "html_escape", "json_apply", "json_clean", "json_compact", "json_delete", "json_delete_clean",
    "json_encode", "json_equal", "json_exists", "json_fields", "json_get", "json_get_all", "json_get_typed", "json_is_empty",
    "json_is_null", "json_merge", "json_pretty", "json_set", "json_set_many", "json_to_array", "json_valid", "json_validate",
    "merge_texts", "native_extract", "native_get", "native_merge", "native_pick", "native_put", "native_remove", "native_slice",
    "native_typed", "safe_get", "set_text", "variant",
]
