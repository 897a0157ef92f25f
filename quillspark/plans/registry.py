"""Tools as named plans: validation, registry, templates from configuration, and guarded SQL with bound values."""

from __future__ import annotations

import importlib
import inspect
import json
import pkgutil
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_TAG = re.compile(r"\{\{([^}]+)\}\}")
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": (list, tuple), "object": dict}


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str = "string"
    description: str = ""
    required: bool = True
    default: Any = None
    enum: tuple = ()


@dataclass(frozen=True)
class Tool:
    """A callable (spark, **values) -> DataFrame with a name, a category and declared parameters."""

    name: str
    run: Callable[..., DataFrame]
    description: str = ""
    category: str = "custom"
    parameters: tuple[Parameter, ...] = ()

    def validate(self, values: Mapping[str, Any]) -> dict[str, Any]:
        """values with defaults; missing ones, wrong types and values outside an enum are refused."""
        out = dict(values)
        for p in self.parameters:
            if p.name not in out:
                if p.required and p.default is None:
                    raise ValueError(f"missing parameter: {p.name}")
                out[p.name] = p.default
            elif out[p.name] is not None and not isinstance(out[p.name], _TYPES[p.type]):
                raise ValueError(f"parameter {p.name} must be {p.type}")
            if p.enum and out[p.name] is not None and out[p.name] not in p.enum:
                raise ValueError(f"parameter {p.name} must be one of {list(p.enum)}")
        return out

    def schema(self, flavour: str = "function") -> dict[str, Any]:
        """A description for callers that pick tools by schema: flavour `function` or `input`."""
        props = {p.name: {"type": p.type, "description": p.description} | ({"enum": list(p.enum)} if p.enum else {}) for p in self.parameters}
        body = {"type": "object", "properties": props, "required": [p.name for p in self.parameters if p.required]}
        if flavour == "function":
            return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": body}}
        return {"name": self.name, "description": self.description, "input_schema": body}


@dataclass
class Result:
    success: bool
    data: DataFrame | None = None
    error: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


class Registry:
    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> None:
        if tool.name in self._tools:
            raise ValueError(f"tool already registered: {tool.name}")
        self._tools[tool.name] = tool

    def unregister(self, name: str) -> None:
        self._tools.pop(name, None)

    def get(self, name: str) -> Tool | None:
        return self._tools.get(name)

    def by_category(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for tool in self._tools.values():
            out.setdefault(tool.category, []).append(tool.name)
        return {k: sorted(v) for k, v in sorted(out.items())}

    def execute(self, spark: SparkSession, name: str, **values: Any) -> Result:
        tool = self.get(name)
        if tool is None:
            return Result(False, error=f"no such tool: {name}")
        try:
            known = inspect.signature(tool.run).parameters
            open_ = any(p.kind is p.VAR_KEYWORD for p in known.values())
            checked = {k: v for k, v in tool.validate(values).items() if open_ or k in known}
            return Result(True, tool.run(spark, **checked), metadata={"tool": name})
        except ValueError as e:
            return Result(False, error=str(e))


def tags_of(config: Any) -> list[str]:
    """Names in {{ }} anywhere in a configuration, each once, in order."""
    if isinstance(config, str):
        found = [t.strip() for t in _TAG.findall(config)]
    elif isinstance(config, Mapping):
        found = [t for v in config.values() for t in tags_of(v)]
    elif isinstance(config, (list, tuple)):
        found = [t for v in config for t in tags_of(v)]
    else:
        found = []
    return list(dict.fromkeys(found))


def interpolated(config: Any, values: Mapping[str, Any]) -> Any:
    """config with {{name}} in its strings replaced; other values keep their type."""
    if isinstance(config, str):
        return _TAG.sub(lambda m: str(values.get(m[1].strip(), m[0])), config)
    if isinstance(config, Mapping):
        return {k: interpolated(v, values) for k, v in config.items()}
    if isinstance(config, (list, tuple)):
        return [interpolated(v, values) for v in config]
    return config


def configured_tool(name: str, config: Mapping[str, Any], explicit: tuple[Parameter, ...] = ()) -> Tool:
    """A tool that runs the SQL of its configuration; its tags become bound parameters, never parts of the text."""
    tags = tags_of(config)
    named = {p.name for p in explicit}
    parameters = (*explicit, *(Parameter(t) for t in tags if t not in named))

    def run(spark: SparkSession, **values: Any) -> DataFrame:
        return run_sql(spark, _TAG.sub(lambda m: f":{m[1].strip()}", config["sql"]), {t: values[t] for t in tags_of(config["sql"])})

    return Tool(name, run, config.get("description", ""), "custom", parameters)


def check_select(spark: SparkSession, sql: str) -> str:
    """sql if Spark's parser takes it for one query: no command, no statement that writes, no script, at any depth."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise ValueError(f"no single SQL statement: {str(e).splitlines()[0]}") from None
    loader = plan.getClass().getClassLoader()
    refused = [loader.loadClass(f"org.apache.spark.sql.catalyst.plans.logical.{name}") for name in ("Command", "ParsedStatement", "ScriptTransformation")]
    open_ = [plan]
    while open_:
        node = open_.pop()
        if any(kind.isInstance(node) for kind in refused):
            raise ValueError("only SELECT statements run here")
        for below in (node.children(), node.innerChildren(), node.subqueries()):
            open_ += [x for x in (below.apply(i) for i in range(below.size())) if loader.loadClass("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan").isInstance(x)]
    return sql.strip().rstrip(";")


def run_sql(spark: SparkSession, sql: str, values: Mapping[str, Any] | None = None, tables: Mapping[str, DataFrame] | None = None, fetch_size: int = 100) -> DataFrame:
    """A SELECT with named values over the session's tables and those given; fetch_size 0 or less returns all rows."""
    statement = check_select(spark, sql)
    before: dict[str, DataFrame | None] = {}
    try:
        for name, df in (tables or {}).items():
            before[name] = spark.table(name) if any(t.isTemporary and t.name.lower() == name.lower() for t in spark.catalog.listTables()) else None
            df.createOrReplaceTempView(name)
        out = spark.sql(statement, args=dict(values or {}))  # names are resolved here; the views can go
    finally:
        for name, df in before.items():
            spark.catalog.dropTempView(name) if df is None else df.createOrReplaceTempView(name)
    return out.limit(fetch_size) if fetch_size > 0 else out


def discover(package: str) -> dict[str, Tool]:
    """Tools that the modules of a package define, by name; a name that occurs again keeps the first, in order of modules."""
    root = importlib.import_module(package)
    found: dict[str, Tool] = {}
    for info in sorted(pkgutil.iter_modules(root.__path__, f"{root.__name__}."), key=lambda m: m.name):
        if not info.ispkg:
            for _, value in sorted(vars(importlib.import_module(info.name)).items()):
                if isinstance(value, Tool):
                    found.setdefault(value.name, value)
    return found


_EXAMPLES = {"string": None, "integer": 100, "number": 100, "boolean": True, "object": {}, "array": []}


def tool_rows(spark: SparkSession, tools: Iterable[Tool]) -> DataFrame:
    """tool_type, name, description, config_schema and example (JSON) of tools, as rows for sync.sync_templates."""
    rows = []
    for tool in tools:
        props = {p.name: {"type": p.type, "description": p.description, "required": p.required, "default": p.default, "enum": list(p.enum)} for p in tool.parameters}
        shown = {p.name: p.default if p.default is not None else f"example_{p.name}" if p.type == "string" else _EXAMPLES[p.type] for p in tool.parameters}
        rows.append((tool.name.lower(), tool.name, tool.description, json.dumps({"type": "object", "properties": props}), json.dumps(shown)))
    return spark.createDataFrame(rows, "tool_type string, name string, description string, config_schema string, example string")
