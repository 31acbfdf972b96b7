"""Markdown documents with YAML frontmatter: parsing, writing, loading and saving of bundles.

Files are listed once, read and parsed where they lie, and come out as a DataFrame of concepts; what cannot be parsed
is kept apart with its reason. Queries then run over columns (best over a table written once), never over files.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marrow.functions.text import nz
from marrow.operators.bundle import default_path

try:
    import yaml
except ImportError:  # then frontmatter of one level is read line by line
    yaml = None

CORE = ("type", "title", "description", "resource", "tags", "timestamp")
_FRONT = re.compile(r"\A---(\r?\n.*?)---[\r\n]+(.*)\Z", re.S)

if yaml:

    class _Loader(yaml.SafeLoader):
        """Scalars as in YAML 1.2 where it matters: only true and false are booleans, dates stay text; repeated keys are errors."""

        yaml_implicit_resolvers = {
            k: [(tag, rx) for tag, rx in v if tag not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()
        }

        def construct_mapping(self, node, deep=False):  # noqa: ANN001, ANN201
            seen = set()
            for key, _ in node.value:
                name = self.construct_object(key, deep=True)
                if name in seen:
                    raise yaml.constructor.ConstructorError(None, None, f"repeated key {name!r}", key.start_mark)
                seen.add(name)
            return super().construct_mapping(node, deep)

    _Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


class DocumentError(ValueError):
    """A document that is no concept."""


def split_document(text: str) -> tuple[str | None, str]:
    """Frontmatter (None if there is none) and body.

    It ends at the first three hyphens before a line end, wherever they stand; three hyphens that end the text do not
    close it, and the whole is body then. Line ends at the beginning of the body are dropped.
    """
    m = _FRONT.match(text) if text.startswith(("---\n", "---\r\n")) else None
    if not m:
        return None, text
    return m[1], m[2].lstrip("\r\n")


def title_from_path(path: str) -> str:
    base = posixpath.basename(path)
    return (base[:-3] if base.endswith(".md") else base).replace("_", " ").replace("-", " ")


def _literal(node) -> str:  # noqa: ANN001
    return "" if node.tag == "tag:yaml.org,2002:null" else node.value


def _fields(front: str) -> tuple[dict, dict]:
    """Core fields as they are written, and further fields with their values resolved."""
    if yaml is None:
        core, more, key = {}, {}, ""
        for line in map(str.strip, front.split("\n")):
            if line.startswith("- ") and key:
                core.setdefault(key, []).append(line[2:].strip())
            elif ":" in line:
                k, _, v = line.partition(":")
                key = k.strip()
                v = v.strip().strip("\"'")
                (core if key in CORE else more)[key] = v if v else []
        return {k: v for k, v in core.items()}, {k: v for k, v in more.items() if v != []}
    loader = _Loader(front)
    try:
        node = loader.get_single_node()
        if node is None:
            return {}, {}
        if not isinstance(node, yaml.MappingNode):
            raise DocumentError("frontmatter is no mapping")
        values = loader.construct_document(node)
    finally:
        loader.dispose()
    core = {}
    for k, v in node.value:
        if k.value in CORE:
            if k.value == "tags":
                if isinstance(v, yaml.SequenceNode):
                    core["tags"] = [_literal(x) for x in v.value]
                elif _literal(v) != "":
                    raise DocumentError("tags are no list")
            elif not isinstance(v, yaml.ScalarNode):
                raise DocumentError(f"{k.value} is no text")
            else:
                core[k.value] = _literal(v)
    return core, {str(k): v for k, v in values.items() if k not in CORE}


def _text(v) -> tuple[str, str]:  # noqa: ANN001
    """A value as text, with its kind."""
    if isinstance(v, bool):
        return ("true" if v else "false"), "bool"
    if isinstance(v, (int, float)):
        return str(v), "number"
    if isinstance(v, str):
        return v, "string"
    return ("", "null") if v is None else (yaml.safe_dump(v, default_flow_style=True).strip() if yaml else str(v), "other")


#: Fields that count only if they are written as text.
TEXT_FIELDS = ("source_path", "language", "symbol_kind", "qualified_name", "relation_kind", "relation_source", "relation_target", "provenance", "generator")


def parse_document(text: str, path: str) -> dict:
    """A concept; raises DocumentError for an empty text, frontmatter that is no YAML, or a missing type or title."""
    if text == "":
        raise DocumentError("empty document")
    front, body = split_document(text)
    if front is None:
        return {"type": "concept", "title": title_from_path(path), "description": "", "resource": "", "tags": [], "timestamp": "", "content": text, "file_path": path, "custom": {}, "custom_types": {}}
    try:
        core, more = _fields(front)
    except DocumentError:
        raise
    except Exception as e:  # noqa: BLE001  any error of the YAML library
        raise DocumentError(f"frontmatter: {e}") from e
    for name in ("title", "type"):
        if not core.get(name):
            raise DocumentError(f"missing {name}")
    custom, types = {}, {}
    for k, v in more.items():
        custom[k], types[k] = _text(v)
        if k in TEXT_FIELDS and types[k] != "string":
            del custom[k]
    return {n: core.get(n, "") for n in ("type", "title", "description", "resource", "timestamp")} | {"tags": core.get("tags", []), "content": body, "file_path": path, "custom": custom, "custom_types": types}


def validate_strict(text: str) -> str:
    """The reason why a text is no concept, or nothing."""
    try:
        parse_document(text, "")
        return "" if split_document(text)[0] is not None else "missing type"
    except DocumentError as e:
        return str(e)


def validate_lenient(text: str) -> str:
    """The reason why a text's frontmatter cannot be read, or nothing; a text without frontmatter is fine."""
    if not text.startswith(("---\n", "---\r\n")):
        return ""
    front, closed, _ = text[3:].partition("\n---")
    if not closed:
        return "unterminated frontmatter"
    if yaml:
        try:
            if (got := yaml.load(front, _Loader)) is not None and not isinstance(got, dict):  # noqa: S506  a safe loader
                return "invalid frontmatter: no mapping"
        except Exception as e:  # noqa: BLE001
            return f"invalid frontmatter: {e}"
    return ""


def _scalar(v: str) -> str:
    if yaml is None:
        return v
    return yaml.safe_dump(v, allow_unicode=True, width=1 << 30, default_flow_style=True).removesuffix("\n").removesuffix("\n...")


def render_document(c: dict) -> str:
    """Frontmatter (core fields in their order, then others by name) and body; reading it gives the same concept."""
    out = ["---\n", f"type: {_scalar(c['type'])}\n", f"title: {_scalar(c['title'])}\n"]
    for name in ("description", "resource"):
        if c.get(name):
            out.append(f"{name}: {_scalar(c[name])}\n")
    tags = c.get("tags")
    if tags is not None and len(tags):
        out.append("tags:\n")
        out += [f"  - {_scalar(t)}\n" for t in tags]
    if c.get("timestamp"):
        out.append(f"timestamp: {_scalar(c['timestamp'])}\n")
    types = dict(c.get("custom_types") or {})
    for k, v in sorted(dict(c.get("custom") or {}).items()):
        out.append(f"{k}: {v if types.get(k, 'string') in ('bool', 'number', 'other') else '' if types.get(k) == 'null' else _scalar(v)}\n")
    body = c.get("content") or ""
    out.append("---\n\n" if body and not body.endswith("\n") else "---\n")
    return "".join(out) + body + ("\n" if body and not body.endswith("\n") else "")


def render_texts(concepts: DataFrame) -> DataFrame:
    """(file_path, text): every concept as a document."""
    have = [c for c in _COLUMNS if c in concepts.columns and c != "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"file_path": pdf["file_path"], "text": [render_document(r) for r in pdf.to_dict("records")]})

    return concepts.select(*have).mapInPandas(run, "file_path string, text string")


PARSED = "file_path string, type string, title string, description string, resource string, tags array<string>, timestamp string, content string, custom map<string,string>, custom_types map<string,string>, error string"
_COLUMNS = [c.split()[0] for c in PARSED.split(", ")]


def parse_texts(texts: DataFrame) -> DataFrame:
    """``texts`` (file_path, text[, ord]) parsed; ``error`` is NULL for concepts."""
    keep_ord = "ord" in texts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    d = parse_document(r.text or "", r.file_path) | {"error": None}
                except DocumentError as e:
                    d = {"file_path": r.file_path, "error": str(e)}
                rows.append([d.get(c) for c in _COLUMNS])
            out = pd.DataFrame(rows, columns=_COLUMNS)
            if keep_ord:
                out["ord"] = pdf["ord"].to_numpy()
            yield out

    cols = ["file_path", "text", *(["ord"] if keep_ord else [])]
    return texts.select(*cols).mapInPandas(run, PARSED + (", ord long" if keep_ord else ""))


def list_files(root: str, recursive: bool = True, suffix: str = ".md", any_case: bool = False, hidden: bool = False) -> list[tuple[str, int, float]]:
    """(path below root, size, time) in order of their parts; folders that begin with a dot are passed over unless ``hidden``."""
    found = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if hidden or not d.startswith("."))
        if not recursive:
            dirs[:] = []
        for name in names:
            if (name.lower() if any_case else name).endswith(suffix):
                full = os.path.join(folder, name)
                try:
                    s = os.stat(full)
                except OSError:
                    continue
                found.append((os.path.relpath(full, root).replace(os.sep, "/"), s.st_size, s.st_mtime))
    return sorted(found, key=lambda f: f[0].split("/"))


def load_texts(spark: SparkSession, root: str, recursive: bool = True, where: Column | None = None, **listing) -> DataFrame:
    """(ord, file_path, text) of the documents below a folder that all executors see.

    ``where`` is over path, size and mtime, and is decided before anything is read. Other file systems are read by
    Spark's own reader of binary files.
    """
    if "://" in root and not root.startswith("file://"):
        base = root.rstrip("/") + "/"
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.md").load(root)
        listed = raw.select(F.expr(f"substring(path, locate('{base}', path) + {len(base)})").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
        chosen = listed.where(~F.col("file_path").rlike(r"(^|/)\.[^/]*/"))
        chosen = chosen.where(where) if where is not None else chosen
        from marrow.operators.rank import numbered

        sorted_rows = chosen.select("file_path", F.decode("content", "utf-8").alias("text")).orderBy(F.split("file_path", "/"))
        return numbered(sorted_rows, "ord").select((F.col("ord") - 1).alias("ord"), "file_path", "text")
    folder = os.path.abspath(root.removeprefix("file://"))
    files = [(i, p, s, m) for i, (p, s, m) in enumerate(list_files(folder, recursive, **listing))]
    listed = spark.createDataFrame(files, "ord long, file_path string, size long, mtime double").withColumn("path", F.col("file_path")).withColumn("mtime", F.timestamp_seconds("mtime"))
    if where is not None:
        listed = listed.where(where)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for p in pdf["file_path"]:
                try:
                    with open(os.path.join(folder, p), "rb") as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                except OSError:
                    texts.append(None)
            yield pdf.assign(text=texts)

    parts = max(1, min(len(files) // 200 + 1, 10_000))
    return listed.select("ord", "file_path").repartition(parts).mapInPandas(read, "ord long, file_path string, text string")


def load_bundle(spark: SparkSession, root: str, recursive: bool = True, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Concepts of a folder, in order, and what could not be parsed (file_path, error)."""
    parsed = parse_texts(load_texts(spark, root, recursive, where))
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("file_path", "error")


def save_paths(concepts: DataFrame, keep_collisions: bool = False) -> DataFrame:
    """``concepts`` with ``save_path``: their own path or one made of type and title; of equal paths the second gets ``_1`` and so on."""
    raw = F.when(nz("file_path") != "", F.col("file_path")).otherwise(default_path(nz("type"), nz("title")))
    if keep_collisions:  # generated files: one per source, the suffix added
        return concepts.withColumn("save_path", F.when(raw.endswith(".md"), raw).otherwise(F.concat(raw, F.lit(".md"))))
    n = F.row_number().over(Window.partitionBy("_p").orderBy("ord")) - 1
    stem, ext = F.regexp_extract("_p", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("_p", r"^(.*?)(\.[^./]*)?$", 2)
    named = F.when(F.col("_n") == 0, F.col("_p")).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext))
    return concepts.withColumn("_p", raw).withColumn("_n", n).withColumn("save_path", named).drop("_p", "_n")


def save_bundle(concepts: DataFrame, root: str, generated: bool = False) -> DataFrame:
    """Write a document per concept below a shared folder; (save_path, error) of each, ``error`` NULL where it was written."""
    folder = os.path.abspath(root.removeprefix("file://"))
    have = [c for c in _COLUMNS if c in concepts.columns and c != "error"]
    rows = save_paths(concepts, generated).select(*have, "save_path")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                path = os.path.normpath(os.path.join(folder, r["save_path"]))
                try:
                    if not path.startswith(folder + os.sep):
                        raise OSError("path leaves the folder")
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(path + ".part", "w", encoding="utf-8", newline="") as f:
                        f.write(render_document(r))
                    os.replace(path + ".part", path)
                    out.append((r["save_path"], None))
                except (OSError, KeyError) as e:
                    out.append((r["save_path"], str(e)))
            yield pd.DataFrame(out, columns=["save_path", "error"])

    from marrow.functions.session import written

    return written(rows.mapInPandas(write, "save_path string, error string"), "saved")


def remove_files(paths: DataFrame, root: str) -> int:
    """Remove the files of ``paths`` (save_path) below a shared folder, on the executors; how many there were."""
    folder = os.path.abspath(root.removeprefix("file://"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = 0
            for p in pdf["save_path"]:
                path = os.path.normpath(os.path.join(folder, p))
                if path.startswith(folder + os.sep) and os.path.isfile(path):
                    os.remove(path)
                n += 1
            yield pd.DataFrame({"n": [n]})

    return int(paths.select("save_path").distinct().mapInPandas(remove, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
