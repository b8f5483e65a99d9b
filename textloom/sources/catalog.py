"""Where the dumps of a project, language and date lie: base/<project>/<lang><project>/<date>/..."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECTS = {"wikipedia": "wiki", **{p: p for p in ("wiktionary", "wikidata", "wikibooks", "wikinews", "wikiquote", "wikisource", "wikiversity", "wikivoyage", "wikimedia")}}


def directory_of(project: str) -> str:
    return PROJECTS.get(project.lower(), "wiki")


def project_of(directory: str) -> str:
    return next((p for p, d in PROJECTS.items() if d == directory), "wikipedia")


def is_date(name: str) -> bool:
    return len(name) == 8 and name[0] == "2" and name.isascii() and name.isdigit()


@dataclass(frozen=True)
class DumpPath:
    """base is given explicitly; nothing is looked for in parent folders."""

    base: str
    project: str = "wikipedia"
    language: str = "en"
    date: str = ""

    def of(self, **changes) -> DumpPath:
        return replace(self, **changes)

    @property
    def wiki(self) -> str:
        return self.language + directory_of(self.project)

    @property
    def folder(self) -> str:
        return f"{self.base.rstrip('/')}/{self.wiki}"

    @property
    def symbolic_name(self) -> str:
        return f"{self.wiki}-{self.date}"

    @property
    def dump_file(self) -> str:
        return f"{self.folder}/{self.date}/{self.wiki}-{self.date}-pages-articles-multistream.xml.bz2"

    @property
    def index_file(self) -> str:
        return f"{self.folder}/{self.date}/{self.wiki}-{self.date}-pages-articles-multistream-index.txt.bz2"

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def available_dates(self, spark: SparkSession) -> list[str]:
        return [n for n in self._names(spark, self.folder) if is_date(n)]

    def available_languages(self, spark: SparkSession) -> list[str]:
        end = directory_of(self.project)
        return [n[: -len(end)] for n in self._names(spark, self.base) if n.endswith(end) and len(n) > len(end)]

    def newest(self, spark: SparkSession) -> DumpPath:
        """Of the newest date, if none is set."""
        dates = self.available_dates(spark)
        return self if self.date or not dates else self.of(date=dates[-1])

    def size(self, spark: SparkSession, index: bool = False) -> int | None:
        """Bytes of the dump (or its index); None if it isn't there."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.index_file if index else self.dump_file)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return system.getFileStatus(path).getLen() if system.exists(path) else None


def file_names(df: DataFrame, project: str = "project", lang: str = "lang", date: str = "date") -> DataFrame:
    """df with dump_file, index_file and symbolic, for tables of dumps."""
    names = F.create_map(*(F.lit(x) for p in PROJECTS.items() for x in p))
    stem = F.concat(F.col(lang), F.coalesce(names[F.lower(F.col(project))], F.lit("wiki")), F.lit("-"), F.col(date))
    return df.withColumns({
        "dump_file": F.concat(stem, F.lit("-pages-articles-multistream.xml.bz2")), "index_file": F.concat(stem, F.lit("-pages-articles-multistream-index.txt.bz2")), "symbolic": stem,
    })


def newest_dates(names: DataFrame, name: str = "name", *keys: str) -> DataFrame:
    """The newest date of each of keys among names that are dates."""
    return names.where(F.col(name).rlike("^2[0-9]{7}$")).groupBy(*keys).agg(F.max(name).alias("date"))
