"""Field access on parsed JSON: a key that is present with null hides the next alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated once.

    Spark moves a filter below the projection that makes its column and so evaluates the
    column again; it does not move one below a generator, here of one row.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def path(value: str, dotted: str) -> str:
    return f"variant_get({value}, '$.{dotted}', 'variant')"


def first_of(value: str, *keys: str) -> str:
    """The first key that is present, even when its value is a JSON null."""
    parts = [path(value, key) for key in keys]
    return parts[0] if len(parts) == 1 else f"coalesce({', '.join(parts)})"


def string(value: str) -> str:
    return f"if(schema_of_variant({value}) = 'STRING', try_variant_get({value}, '$', 'string'), null)"


def _is_number(value: str) -> str:
    return f"schema_of_variant({value}) rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'"


def integer(value: str) -> str:
    """Whole numbers as they are, other numbers cut towards zero."""
    return (
        f"case when schema_of_variant({value}) = 'BIGINT' then try_variant_get({value}, '$', 'bigint') "
        f"when {_is_number(value)} then try_cast(try_variant_get({value}, '$', 'double') as bigint) end"
    )


def double(value: str) -> str:
    return f"if({_is_number(value)}, try_variant_get({value}, '$', 'double'), null)"


def epoch_ms(value: str) -> str:
    """A number below 1e11 is in seconds."""
    number = f"({integer(value)})"
    return f"if(abs({number}) < 100000000000L, {number} * 1000L, {number})"


def nested_string(value: str, *keys: str) -> str:
    """The first key that holds a string, trimmed; null when that is blank."""
    found = ", ".join(string(path(value, key)) for key in keys)
    return f"nullif(trim(coalesce({found}, cast(null as string))), '')"


def effort(value: str) -> str:
    settings = path(value, "collaboration_mode.settings")
    return (
        f"coalesce({nested_string(value, 'reasoning_effort', 'reasoningEffort', 'effort')}, "
        f"{nested_string(settings, 'reasoning_effort', 'effort')})"
    )


# Alias keys of the six token counts, in order of preference.
TOKEN_ALIASES = {
    "input_tokens": ["input_tokens", "inputTokens"],
    "cache_read_tokens": [
        "cached_input_tokens",
        "cache_read_input_tokens",
        "cacheReadInputTokens",
    ],
    "cache_write_tokens": [
        "cache_write_input_tokens",
        "cache_creation_input_tokens",
        "cacheCreationInputTokens",
    ],
    "output_tokens": ["output_tokens", "outputTokens"],
    "reasoning_tokens": ["reasoning_output_tokens", "reasoningOutputTokens"],
    "total_tokens": ["total_tokens", "totalTokens"],
}


def token_values(value: str) -> dict[str, str]:
    return {name: first_of(value, *keys) for name, keys in TOKEN_ALIASES.items()}
