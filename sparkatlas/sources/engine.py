"""Macros, build files and plugin files of a game engine's C++ projects, from tables of files (filepath, content)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkatlas.functions import scan
from sparkatlas.functions import text as T

# The patterns by which declarations are recognised.
CLASS_MACRO = re.compile(r"^[ \t]*(UCLASS|USTRUCT|UENUM)\s*\(([^)]*)\)\s*\n", re.MULTILINE)
CLASS_DECL = re.compile(r"^[ \t]*(?:class|struct)\s+(?:([A-Z_]+_API)\s+)?(\w+)(?:\s*:\s*public\s+(\w+))?", re.MULTILINE)
PROPERTY = re.compile(r"^[ \t]*UPROPERTY\s*\(([^)]*)\)\s*\n[ \t]*(\w[\w:<>,\s\*&]*?)\s+(\w+)\s*[;={]", re.MULTILINE)
FUNCTION = re.compile(r"^[ \t]*UFUNCTION\s*\(([^)]*)\)\s*\n[ \t]*(?:virtual\s+)?(\w[\w:<>,\s\*&]*?)\s+(\w+)\s*\(", re.MULTILINE)
BUILD_CLASS = r"class\s+(\w+)\s*:\s*ModuleRules"
ADD_RANGE = r"(\w+DependencyModuleNames)\.AddRange\s*\(\s*new\s+string\s*\[\]\s*\{([^}]*)\}"
ADD_ONE = r'(\w+DependencyModuleNames)\.Add\s*\(\s*"([^"]+)"\s*\)'
INCLUDE_PATH = r'(Public|Private)IncludePaths\.Add\s*\(\s*"([^"]+)"\s*\)'


def specifiers(text: str) -> tuple[list[str], dict[str, str]]:
    """The plain specifiers of a macro, and its key=value pairs, those within meta=( ) too."""
    meta, at = {}, text.find("meta=(")
    if at >= 0:
        end, depth = at + 6, 1
        while end < len(text) and (depth := depth + (text[end] == "(") - (text[end] == ")")):
            end += 1
        inner, outer = text[at + 6 : end], [text[:at].strip().rstrip(", "), text[end + 1 :].strip().lstrip(", ")]
        pairs = [p for p in scan.split_top_level(inner) if "=" in p]
        text = ", ".join(x for x in outer if x)
    else:
        pairs = []
    parts = [p for p in scan.split_top_level(text.strip()) if p]
    for p in [*pairs, *(p for p in parts if "=" in p)]:
        key, _, value = p.partition("=")
        meta[key.strip()] = value.strip().strip('"')
    return [p for p in parts if "=" not in p], meta


def macros_of(text: str) -> dict[str, dict]:
    """By class name: its macro, specifiers, meta, and the properties and functions declared after it."""
    out: dict[str, dict] = {}
    for m in CLASS_MACRO.finditer(text):
        if d := CLASS_DECL.search(text, m.end()):
            names, meta = specifiers(m[2])
            out[d[2]] = {"macro_type": m[1], "api_macro": d[1] or "", "specifiers": names, "meta": meta, "properties": [], "functions": []}
    places = {c: p for c in out if (p := text.find(f"class {c}")) >= 0 or (p := text.find(f"struct {c}")) >= 0}

    def attach(pattern: re.Pattern, field: str) -> None:
        for m in pattern.finditer(text):
            names, meta = specifiers(m[1])
            own = {"name": m[3], "specifiers": names, "category": meta.pop("Category", ""), "meta": meta} | ({"type": m[2].strip()} if field == "properties" else {})
            owner = max(((p, c) for c, p in places.items() if p < m.start()), default=None)
            if owner:
                out[owner[1]][field].append(own)

    attach(PROPERTY, "properties")
    attach(FUNCTION, "functions")
    return out


def without_empty(x):
    if isinstance(x, dict):
        return {k: y for k, v in x.items() if (y := without_empty(v)) not in ("", [], {}, None)}
    return [without_empty(v) for v in x] if isinstance(x, list) else x


def macros(files: DataFrame) -> DataFrame:
    """filepath, class_name, macro_type, n_properties, n_functions and meta (JSON without what is empty) for C++ files."""

    def run(batches):
        for batch in batches:
            rows = [(path, c, m["macro_type"], len(m["properties"]), len(m["functions"]), json.dumps(without_empty(m), sort_keys=True)) for path, text in zip(batch["filepath"], batch["content"], strict=True) for c, m in macros_of(text or "").items()]
            yield pd.DataFrame(rows, columns=["filepath", "class_name", "macro_type", "n_properties", "n_functions", "meta"])

    return files.where(T.is_cpp_file(F.col("filepath"))).select("filepath", "content").mapInPandas(run, "filepath string, class_name string, macro_type string, n_properties long, n_functions long, meta string")


def build_modules(files: DataFrame) -> DataFrame:
    """filepath, name, folder, dependencies and include paths of .Build.cs files; the names stay inside the JVM."""
    text, base = F.col("content"), F.substring_index("filepath", "/", -1)
    own = files.where(F.col("filepath").endswith(".Build.cs"))
    literals = lambda body: F.regexp_extract_all(body, F.lit(r'"([^"]+)"'), 1)

    def listed(kind) -> F.Column:
        pick = lambda f: f.startswith("PublicDependency") if kind == "Public" else f.startswith("PrivateDependency") if kind == "Private" else ~(f.startswith("PublicDependency") | f.startswith("PrivateDependency"))
        many = F.arrays_zip(F.regexp_extract_all(text, F.lit(ADD_RANGE), 1).alias("f"), F.regexp_extract_all(text, F.lit(ADD_RANGE), 2).alias("v"))
        one = F.arrays_zip(F.regexp_extract_all(text, F.lit(ADD_ONE), 1).alias("f"), F.regexp_extract_all(text, F.lit(ADD_ONE), 2).alias("v"))
        return F.concat(F.flatten(F.transform(F.filter(many, lambda x: pick(x["f"])), lambda x: literals(x["v"]))), F.transform(F.filter(one, lambda x: pick(x["f"])), lambda x: x["v"]))

    paths = lambda kind: F.transform(F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(INCLUDE_PATH), 1).alias("f"), F.regexp_extract_all(text, F.lit(INCLUDE_PATH), 2).alias("v")), lambda x: x["f"] == kind), lambda x: x["v"])
    name = F.regexp_extract(text, BUILD_CLASS, 1)
    public, private = listed("Public"), listed("Private")
    return own.select(
        "filepath", F.when(name != "", name).otherwise(F.regexp_replace(base, r"\.Build\.cs$", "")).alias("name"), F.regexp_replace("filepath", r"/?[^/]*$", "").alias("folder"),
        public.alias("public_dependencies"), private.alias("private_dependencies"), F.concat(listed(""), F.array_sort(F.array_union(public, private))).alias("dependencies"),
        paths("Public").alias("public_include_paths"), paths("Private").alias("private_include_paths"),
    )


def section(text: str, name: str) -> list[str]:
    """The objects of the array of that name, found without a JSON parser, as such files aren't always JSON."""
    at = text.find(f'"{name}"')
    start = text.find("[", at) if at >= 0 else -1
    depth = 0
    for i in range(start, len(text)) if start >= 0 else ():
        depth += (text[i] == "[") - (text[i] == "]")
        if depth == 0:
            return scan.json_blocks(text[start : i + 1])
    return []


def plugin_of(path: str, text: str) -> dict:
    first = lambda pattern, s: m[1] if (m := re.search(pattern, s)) else ""
    name = r'"Name"\s*:\s*"([^"]+)"'
    modules = [{"name": n, "type": first(r'"Type"\s*:\s*"([^"]+)"', b)} for b in section(text, "Modules") if (n := first(name, b))]
    plugins = [{"name": n, "enabled": first(r'"Enabled"\s*:\s*(true|false)', b) == "true"} for b in section(text, "Plugins") if (n := first(name, b))]
    return {"filepath": path, "name": re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]), "description": first(r'"Description"\s*:\s*"([^"]*)"', text), "category": first(r'"Category"\s*:\s*"([^"]*)"', text), "modules": modules, "plugins": plugins}


def plugins(files: DataFrame) -> DataFrame:
    """filepath, name, description, category, modules and plugins of .uplugin and .uproject files."""
    shape = "filepath string, name string, description string, category string, modules array<struct<name:string,type:string>>, plugins array<struct<name:string,enabled:boolean>>"

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([plugin_of(p, t or "") for p, t in zip(batch["filepath"], batch["content"], strict=True)], columns=["filepath", "name", "description", "category", "modules", "plugins"])

    return files.where(F.lower("filepath").rlike(r"\.(uplugin|uproject)$")).select("filepath", "content").mapInPandas(run, shape)
