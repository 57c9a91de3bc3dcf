"""Tables of nested experiment configurations: dotted overrides, component specs and sweeps.

A configuration is a VARIANT, so every row may have its own shape. All steps are column expressions of one row: a table of
configurations is read, changed and resolved without a shuffle.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

MAPPING = "map<string,variant>"


def mapping(value: Column) -> Column:
    """The fields of a VARIANT object; null for anything else, a JSON null included."""
    return F.try_variant_get(value, "$", MAPPING)


def _json(text: str) -> Column:
    return F.parse_json(F.lit(text))


def set_dotted(config: Column, key: Column, value: Column) -> Column:
    """The configuration with the value at a dotted key, other settings untouched.

    Missing levels are created, a mapping that stands at the key is replaced. Null where the configuration, the key or a
    level on the way is something else than a mapping. A null value is stored as a JSON null.
    """
    parts = F.split(key, r"\.")
    last = lambda levels: F.element_at(levels, -1)

    def descend(levels: Column, part: Column) -> Column:
        below = F.try_element_at(last(levels), part)
        # a level that is no mapping stays null all the way down
        entered = F.when(last(levels).isNotNull() & below.isNull(), F.create_map().cast(MAPPING)).otherwise(mapping(below))
        return F.concat(levels, F.array(entered))

    levels = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.array(mapping(config)), descend)

    def ascend(inner: Column, level: Column) -> Column:
        rest = F.map_filter(level.fields, lambda name, _: name != level.part)
        return F.to_variant_object(F.map_concat(rest, F.create_map(level.part, inner)))

    path = F.reverse(F.arrays_zip(parts.alias("part"), levels.alias("fields")))
    changed = F.aggregate(path, F.coalesce(value, _json("null")), ascend)
    return F.when(key.isNotNull() & ~F.exists(levels, lambda level: level.isNull()), changed)


def with_settings(configs: DataFrame, settings: Column, config: str = "config") -> DataFrame:
    """Configurations after all settings (array of struct<key:string,value:variant>) in their order, and ``invalid``.

    ``invalid`` names the first key that can't be set; the configuration of such a row is null. No settings (an empty array or
    null) leave it as it is.
    """
    start = F.struct(F.col(config).alias("config"), F.lit(None).cast("string").alias("invalid"))

    def step(state: Column, setting: Column) -> Column:
        changed = set_dotted(state.config, setting.key, setting.value)
        return F.struct(changed.alias("config"), F.coalesce(state.invalid, F.when(
            changed.isNull(), F.coalesce(setting.key, F.lit("")))).alias("invalid"))

    empty = F.array().cast("array<struct<key:string,value:variant>>")
    result = F.aggregate(F.coalesce(settings, empty), start, step)
    return configs.withColumn("__set", result).withColumns(
        {config: F.col("__set.config"), "invalid": F.col("__set.invalid")}).drop("__set")


def is_unset(value: Column) -> Column:
    """Missing, null, false, zero, or an empty text, list or mapping: such a setting counts as not given."""
    return value.isNull() | F.to_json(value).rlike(r'^(null|false|""|\[\]|\{\}|-?0(\.0+)?(E[0-9]+)?)$')


def component_spec(config: Column, name: str, default: str) -> Column:
    """struct<plugin, params, invalid> of one component of a configuration.

    The component is a text (the plugin alone) or a mapping with ``plugin`` and ``params``; one that is not set has the default
    plugin without parameters. A plugin given as a JSON null reads ``None``, any other value as its JSON text. ``invalid`` says
    what is neither; plugin and params are null then.
    """
    raw = F.try_element_at(mapping(config), F.lit(name))
    fields = mapping(raw)
    plugin, params = (F.try_element_at(fields, F.lit(n)) for n in ("plugin", "params"))
    text = F.when(F.schema_of_variant(raw) == "STRING", F.variant_get(raw, "$", "string"))
    named = (F.when(plugin.isNull(), default).when(F.is_variant_null(plugin), "None")
             .when(F.schema_of_variant(plugin) == "STRING", F.try_variant_get(plugin, "$", "string")).otherwise(F.to_json(plugin)))
    invalid = (F.when(mapping(config).isNull(), "the configuration is no mapping").when(is_unset(raw), None)
               .when(text.isNull() & fields.isNull(), f"{name} must be a text or a mapping")
               .when(fields.isNotNull() & ~is_unset(params) & mapping(params).isNull(), f"{name}.params must be a mapping"))
    given = F.when(is_unset(raw) | fields.isNull() | is_unset(params), _json("{}")).otherwise(params)
    return F.struct(
        F.when(invalid.isNull(), F.when(is_unset(raw), default).otherwise(F.coalesce(text, named))).alias("plugin"),
        F.when(invalid.isNull(), given).alias("params"), invalid.alias("invalid"))


def sweep(configs: DataFrame, axes: dict[str, list], config: str = "config") -> DataFrame:
    """Every configuration under every combination of the axes' values (dotted key to list of JSON texts).

    Adds ``variant_index`` (the last axis runs fastest) and ``invalid``. The combinations are constants of the plan, so each row
    multiplies in its own task.
    """
    def setting(key: str, text: str) -> Column:
        return F.struct(F.lit(key).alias("key"), _json(text).alias("value"))

    grid = [F.struct(F.lit(i).alias("index"), F.array(*[setting(k, v) for k, v in zip(axes, values)]).alias("settings"))
            for i, values in enumerate(product(*axes.values()))] if axes and all(axes.values()) else []
    if not grid:
        return configs.withColumns({"variant_index": F.lit(0), "invalid": F.lit(None).cast("string")})
    rows = configs.withColumn("__variant", F.explode(F.array(*grid)))
    return (with_settings(rows, F.col("__variant.settings"), config)
            .withColumn("variant_index", F.col("__variant.index")).drop("__variant"))
