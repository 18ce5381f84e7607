"""Named datasets: what kind a name is, which constraint it carries, how it is read."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.operators.filters import union_all
from quillspark.sources.readers import read_csv


@dataclass(frozen=True)
class Dataset:
    name: str
    kind: str  # "constraint" or "task"
    constraint_type: Optional[str] = None
    presplit: bool = False  # comes with its own splits; not split again


def _constraint(names: str, constraint_type: str) -> list[Dataset]:
    return [Dataset(n, "constraint", constraint_type) for n in names.split()]


def _task(names: str, presplit: bool = False) -> list[Dataset]:
    return [Dataset(n, "task", None, presplit) for n in names.split()]


# Dataset names, their kinds, constraint types, and which come split.
DATASETS = {
    d.name: d
    for d in [
        *_constraint("imdb yelp_polarity sst2 sst5", "sentiment"),
        *_constraint("ag_news", "topic"),
        *_constraint("cola", "grammar"),
        *_constraint("sms_spam spamassassin", "spam"),
        *_constraint("jigsaw jigsaw_bias", "toxicity"),
        *_constraint("tagmybook storycontrol", "genre"),
        *_constraint("pavlick", "formality"),
        *_constraint("stop_clickbait clickbait_news", "clickbait"),
        *_constraint("urgency", "urgency"),
        *_task("real-toxicity-prompts bookcorpus opus_books tatoeba eli5 scifact fever squad"),
        *_task("sentiment-prompts factuality-prompts nontoxic-prompts roc-stories plain-prompts"),
        *_task("opus100 cnn_dailymail common_gen gigaword xsum writing-prompts", presplit=True),
    ]
}

# What marks the path of a task corpus.
TASK_PATH_MARKERS = ("dexperts", "writing-prompts", "factuality-prompts", "roc-stories")

Reader = Callable[[SparkSession, str], DataFrame]


def route(name: str) -> Dataset:
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}")
    return DATASETS[name]


def route_path(path: str) -> Dataset:
    """A file's dataset: a task if a marker is in its path, else constraint data of its folder's name."""
    *folders, file = path.rstrip("/").split("/")
    name = file.removesuffix(".csv")
    if any(marker in path for marker in TASK_PATH_MARKERS):
        return Dataset(name, "task")
    if not folders:
        raise ValueError(f"{path!r} has no folder to name its constraint")
    return Dataset(name, "constraint", folders[-1])


def route_column(name: Column, what: str) -> Column:
    """The same for a column of names: kind, constraint_type or presplit; null if unknown."""
    known = [d for d in DATASETS.values() if getattr(d, what) is not None]
    pairs = [F.lit(part) for d in known for part in (d.name, str(getattr(d, what)))]
    return F.try_element_at(F.create_map(*pairs), name)


@dataclass(frozen=True)
class Files:
    """How a dataset's files are found and read, as data.

    ``pattern`` is a path with ``*``, ``?``, ``[...]`` and ``{a,b}``, which stay inside one folder level. ``fields`` are
    the columns wanted, each by its name and type in the files; a name not given is the column's own.
    Patterns of one catalog don't overlap.
    """

    dataset: str
    format: str  # csv, json, parquet or text
    pattern: str
    fields: Mapping[str, tuple[str, str]]  # column -> (name in the files, type)
    split: str = "train"
    options: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.format not in FORMATS:
            raise ValueError(f"unknown format {self.format!r}")
        if self.format == "text" and any(name != "value" for name, _ in self.fields.values()):
            raise ValueError("a line of text is named value")

    def scan_key(self) -> tuple:
        """Files with the same key are read by one scan. Delimited files are so only with the same columns in the same order."""
        layout = tuple(self.fields.values()) if self.format == "csv" else ()
        return self.format, tuple(sorted(self.options.items())), layout


# Formats of files, and the options each is read with unless told otherwise.
FORMATS = {
    "csv": {"header": "true", "multiLine": "true", "enforceSchema": "false", "quote": '"', "escape": '"'},
    "json": {}, "parquet": {}, "text": {},
}


def pattern_regex(pattern: str) -> str:
    """A pattern as a regular expression of whole paths; the scheme and host in front may be left out."""
    out, at, depth = "", 0, 0
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", pattern)
    while at < len(path):
        c = path[at]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in path[at + 1 :]:
            end = path.index("]", at + 1)
            inner = path[at + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner).replace("\\", "\\\\") + "]"
            at = end
        else:
            out += re.escape(c)
        at += 1
    return rf"^([A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?)?{out}(/[^/]*)?$"


@dataclass
class Catalog:
    """Readers by dataset name; a reader gets the session and the split to read.

    A corpus outside the known names is registered with its own ``Dataset``, a file by its path, many
    files by ``Files``, which ``scan`` reads all at once.
    """

    spark: SparkSession
    readers: dict[str, Reader] = field(default_factory=dict)
    own: dict[str, Dataset] = field(default_factory=dict)
    files: list[Files] = field(default_factory=list)

    def register(self, name: str, reader: Reader, dataset: Optional[Dataset] = None) -> None:
        if dataset is not None:
            self.own[name] = dataset
        self.route(name)
        self.readers[name] = reader

    def register_file(self, path: str, schema: str, sep: str = ",", split: Optional[str] = None) -> Dataset:
        """A delimited file by its path: folder and markers say what it is.

        A file of one ``split`` is read for that split only; one without holds all of them.
        """
        dataset = route_path(path)
        before = self.readers.get(dataset.name) if split is not None else None

        def read(session: SparkSession, wanted: str) -> DataFrame:
            if split is None or wanted == split:
                return read_csv(session, path, schema, sep)
            if before is None:
                raise ValueError(f"{dataset.name!r} has no split {wanted!r}")
            return before(session, wanted)

        self.register(dataset.name, read, dataset)
        return dataset

    def register_files(self, *specs: Files, dataset: Optional[Dataset] = None) -> None:
        """Files of datasets by their patterns; ``dataset`` describes one outside the known names."""
        for spec in specs:
            if dataset is not None:
                self.own[spec.dataset] = dataset
            self.route(spec.dataset)
            self.files.append(spec)

    def scan(self, columns: Sequence[str], names: Optional[Sequence[str]] = None, split: Optional[str] = None) -> DataFrame:
        """``dataset, split`` and ``columns`` of all registered files, or of some datasets or one split.

        Formats and not files make scans: the paths of all files of a format go into one scan, and each row
        finds its specification by the path it came from. A column that a dataset lacks is null.
        """
        chosen = [f for f in self.files if (names is None or f.dataset in names) and (split is None or f.split == split)]
        if not chosen:
            raise ValueError("no files are registered for this")
        groups: dict[tuple, list[Files]] = {}
        for spec in chosen:
            groups.setdefault(spec.scan_key(), []).append(spec)
        types = {name: kind for spec in chosen for name, (_, kind) in spec.fields.items()}
        unknown = [c for c in columns if c not in types]
        if unknown:
            raise ValueError(f"no files have {unknown}")
        return union_all([self._scan(specs, columns, types) for specs in groups.values()])

    def _scan(self, specs: list[Files], columns: Sequence[str], types: Mapping[str, str]) -> DataFrame:
        fields = {name: kind for spec in specs for name, kind in spec.fields.values()}
        reader = self.spark.read.schema(", ".join(f"`{name}` {kind}" for name, kind in fields.items()))
        options = FORMATS[specs[0].format] | dict(specs[0].options)
        rows = reader.options(**options).format(specs[0].format).load([spec.pattern for spec in specs])
        # Paths in the metadata are escaped like addresses, where a plus sign stands for itself.
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        number = F.lit(None).cast("int")
        for i in range(len(specs) - 1, -1, -1):
            number = F.when(path.rlike(pattern_regex(specs[i].pattern)), F.lit(i)).otherwise(number)
        routed = rows.withColumn("_spec", number)

        def by_spec(values: list[Optional[Column]], kind: str) -> Column:
            out = F.lit(None).cast(kind)
            for i, value in enumerate(values):
                if value is not None:
                    out = F.when(F.col("_spec") == i, value.cast(kind)).otherwise(out)
            return out

        return routed.select(
            by_spec([F.lit(spec.dataset) for spec in specs], "string").alias("dataset"),
            by_spec([F.lit(spec.split) for spec in specs], "string").alias("split"),
            *[by_spec([F.col(f"`{spec.fields[c][0]}`") if c in spec.fields else None for spec in specs], types[c]).alias(c)
              for c in columns])

    def route(self, name: str) -> Dataset:
        return self.own.get(name) or route(name)

    def load(self, name: str, split: str = "train") -> DataFrame:
        self.route(name)
        if name in self.readers:
            return self.readers[name](self.spark, split)
        columns = list(dict.fromkeys(c for f in self.files if f.dataset == name and f.split == split for c in f.fields))
        if not columns:
            raise ValueError(f"no reader registered for {name!r}")
        return self.scan(columns, [name], split).drop("dataset", "split")
