"""Files that the engine reads and writes: JSON lines, word lists, vocabularies, overrides, guides with front matter, HTML pages, CSV lists."""

from __future__ import annotations

import gc
import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "noscript"}


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, bad ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def word_set(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words (word) of text files; none where there is no file."""
    empty = spark.createDataFrame([], "word string")
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    return lines.select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word")).filter("word <> ''").distinct()


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """word and freq of a TSV file; an empty one raises."""
    df = spark.read.schema("word string, freq long").option("sep", "\t").csv(path)
    if df.isEmpty():
        raise ValueError(f"no words in {path}")
    return df


def overrides(spark: SparkSession, path: str, key: str, columns: str) -> DataFrame:
    """Overrides by key, the last line of a file wins; a line without the key raises."""
    df = spark.read.schema(f"{key} string, {columns}").option("mode", "FAILFAST").json(path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a line without {key}"))).otherwise(F.col(key))
    own = [c for c in df.columns if c not in (key, "_at")]
    return df.withColumn(key, checked).groupBy(key).agg(F.max_by(F.struct(*own), "_at").alias("_row")).select(key, "_row.*")


def guides(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """name, front (map of the lines between the --- marks) and body of guides NAME_YEAR.md, those in folders below too if asked for; one without front matter raises."""
    df = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", folders).text(path, wholetext=True)
    return parsed_guides(df.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("body")))


def parsed_guides(rows: DataFrame) -> DataFrame:
    """name, front and body of rows (name, body: the whole file)."""
    df = rows.filter(F.col("name").rlike(r"^[A-Za-z]{4}[0-9]{4}_[0-9]{4}\.md$")).withColumnRenamed("body", "value")
    pattern = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
    front = F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 1)).otherwise(F.raise_error(F.concat(F.lit("no front matter: "), F.col("name"))))
    lines = F.filter(F.split(front, r"\r?\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    return df.select("name", F.map_from_entries(pairs).alias("front"), F.regexp_extract("value", pattern, 2).alias("body"), front.alias("front_text"))


def _scalar(x: str) -> object:
    x = x.strip()
    if x[:1] in "\"'" and x[-1:] == x[:1] and len(x) > 1:
        return x[1:-1]
    if x.startswith("[") and x.endswith("]"):
        return [_scalar(y) for y in x[1:-1].split(",") if y.strip()]
    low = x.lower()
    if low in ("", "~", "null"):
        return None
    if low in ("true", "yes", "on", "false", "no", "off"):
        return low in ("true", "yes", "on")
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return x


def front_matter(text: str) -> object:
    """Maps and lists by indentation, with plain, quoted and bracketed values: what front matter is made of. Anything else raises."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(i: int, depth: int) -> tuple[object, int]:
        if lines[i][1].startswith("- ") or lines[i][1] == "-":
            out: list = []
            while i < len(lines) and lines[i][0] == depth and lines[i][1].startswith("-"):
                rest = lines[i][1][1:].strip()
                inner = depth + len(lines[i][1]) - len(rest)
                if not rest:
                    value, i = block(i + 1, lines[i + 1][0])
                elif _entry(rest):
                    lines[i] = (inner, rest)  # a map that begins beside its dash
                    value, i = block(i, inner)
                else:
                    value, i = _scalar(rest), i + 1
                out.append(value)
            return out, i
        found: dict = {}
        while i < len(lines) and lines[i][0] == depth and (entry := _entry(lines[i][1])):
            key, rest = entry
            if rest:
                found[key], i = _scalar(rest), i + 1
            elif i + 1 < len(lines) and (lines[i + 1][0] > depth or lines[i + 1][0] == depth and lines[i + 1][1].startswith("-")):
                found[key], i = block(i + 1, lines[i + 1][0])
            else:
                found[key], i = None, i + 1
        return found, i

    if not lines:
        return {}
    value, end = block(0, lines[0][0])
    if end < len(lines):
        raise ValueError(f"front matter can't be read: {lines[end][1]}")
    return value


def _entry(line: str) -> tuple[str, str] | None:
    key, colon, rest = line.partition(":")
    plain = colon and key.replace("_", "").replace("-", "").isalnum() and (not rest or rest[0] == " ")
    return (key.strip(), rest.strip()) if plain else None


def front_variant(text: Column) -> Column:
    """Front matter as a variant; one that isn't a map raises."""

    def read(values: pd.Series) -> pd.Series:
        out = [front_matter(x or "") for x in values]
        if not all(isinstance(x, dict) for x in out):
            raise ValueError("front matter isn't a map")
        return pd.Series([json.dumps(x, ensure_ascii=False) for x in out], dtype="object")

    return F.parse_json(F.pandas_udf(read, "string")(text))


class _Page(HTMLParser):
    """Title, headings and text of a page, without menus and scripts; text of paragraphs on lines of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.title, self.out = "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.out.append("\n" if tag == "br" else "")
            return
        ad = any(k == "class" and "ad" in (v or "").split() for k, v in attrs)
        self.open.append(f"{tag}!" if tag in SKIPPED or ad else tag)
        if tag in ("h1", "h2", "h3"):
            self.out.append("\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "li", "div", "tr"):
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        names = [x.rstrip("!") for x in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]
        if tag in ("h1", "h2", "h3", "p", "li", "div", "tr"):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] == "title":
            self.title += data
        elif not any(x.endswith("!") for x in self.open):
            self.out.append(data)


def read_html(html: str | None) -> tuple[str, str]:
    page = _Page()
    page.feed(html or "")
    page.close()
    lines = (" ".join(x.split()) for x in "".join(page.out).split("\n"))
    return " ".join(page.title.split()), "\n".join(x for x in lines if x)


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with _title and _text (Markdown headings and lines)."""

    def read(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_html(x) for x in values], columns=["title", "text"])

    df = pages.withColumn("_page", F.pandas_udf(read, "title string, text string")(html))
    return df.withColumns({"_title": F.col("_page.title"), "_text": F.col("_page.text")}).drop("_page")


def embedded_object(html: Column, name: str) -> Column:
    """The first JSON object after `window.NAME =`, as text; null where none can be read."""

    def first(values: pd.Series) -> pd.Series:
        out = []
        for x in values:
            _, found, rest = (x or "").partition(f"window.{name}")
            at = rest.find("{")
            try:
                out.append(json.dumps(json.JSONDecoder().raw_decode(rest, at)[0], ensure_ascii=False) if found and at >= 0 else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype="object")

    return F.pandas_udf(first, "string")(html)


def sections(markdown: str) -> Iterator[tuple[str, str, str]]:
    """(h2, h3, body) of the parts of a text: # and ## begin one and clear h3, ### begins one under the same h2; empty ones go."""
    h2 = h3 = ""
    held: list[str] = []
    for line in [*markdown.splitlines(), "# "]:
        mark = len(line) - len(line.lstrip("#"))
        if not (1 <= mark <= 3 and line[mark : mark + 1] in (" ", "\t")):
            held.append(line)
            continue
        if body := "\n".join(held).strip():
            yield h2, h3, body
        held = []
        h2, h3 = (h2, line[mark:].strip()) if mark == 3 else (line[mark:].strip(), "")


def tokens(x: str) -> int:
    return max(1, len(x) // 4)


def packed(parts: Iterator[tuple[str, str, str]], most: int, overlap: int = 0) -> Iterator[tuple[str, str, str]]:
    """Parts joined while they hold no more than most tokens (of four characters), under the headings of the first; a longer one is cut into windows that overlap."""
    held: tuple[str, str, str] | None = None
    for h2, h3, body in parts:
        if tokens(body) > most:
            if held:
                yield held
            held = None
            for i in range(0, len(body), (most - overlap) * 4):
                if piece := body[i : i + most * 4].strip():
                    yield h2, h3, piece
        elif held and tokens(held[2]) + tokens(body) <= most:
            held = (*held[:2], f"{held[2]}\n\n{body}")
        else:
            if held:
                yield held
            held = (h2, h3, body)
    if held:
        yield held


def chunks(pages: DataFrame, id_column: str, most: int = 200, least: int = 10, overlap: int = 20) -> DataFrame:
    """chunk_id, id, heading, text, tokens and short of the chunks of pages (_title, _text): sections by headings, packed; under least tokens they go."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, title, body in zip(pdf["id"], pdf["_title"], pdf["_text"], strict=True):
                kept = [(" > ".join(dict.fromkeys(x for x in (title, h2, h3) if x)), x) for h2, h3, x in packed(sections(body or ""), most, overlap) if tokens(x) >= least]
                rows += [(f"{key}-{n}", key, heading, x, tokens(x), tokens(x) < 30) for n, (heading, x) in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["chunk_id", "id", "heading", "text", "tokens", "short"])

    df = pages.select(F.col(id_column).cast("string").alias("id"), "_title", "_text")
    return df.mapInPandas(cut, "chunk_id string, id string, heading string, text string, tokens int, short boolean")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for files that executors share: under spark.checkpoint.dir. A session in one process may do without the setting; any other raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-lodestone-')}"
    return f"{base.rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to a fresh folder and read back; what its plan has shuffled is freed, which Spark else puts off until the driver collects its garbage."""
    path, spark = scratch(df.sparkSession, name), df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def identity(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a file or folder from another: the names, sizes and times of its files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(at)
    return tuple(sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in files))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """A CSV list with a header: all columns as text. A file without the column url raises."""
    df = spark.read.option("header", True).csv(path)
    if "url" not in df.columns:
        raise ValueError(f"no column url in {path}")
    return df


def write_url_list(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_named(df: DataFrame, path: str, suffix: str) -> None:
    """A file for each row of df (name, text): name.suffix, with a line feed at its end; a name may begin with folders (a/b), and one that comes twice raises.
    Tasks write them side by side elsewhere; when all are whole they get their names, one by one."""
    spark = df.sparkSession
    made = scratch(spark, "named")
    once = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("more than one file of a name: "), "name"))).otherwise(F.first("text"))
    df.groupBy("name").agg(once.alias("value")).select("value", "name").write.partitionBy("name").text(made)
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    at, to = fs.Path(made), fs.Path(path)
    files = at.getFileSystem(conf)
    files.mkdirs(to)
    there = set()
    for folder in files.listStatus(at):
        if folder.isDirectory():
            name = folder.getPath().getName().removeprefix("name=").replace("%2F", "/")
            if (below := name.rpartition("/")[0]) not in there:
                files.mkdirs(fs.Path(f"{path}/{below}"))
                there.add(below)
            for part in files.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    if not files.rename(part.getPath(), fs.Path(f"{path}/{name}.{suffix}")):
                        raise FileExistsError(f"{path}/{name}.{suffix}")


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Rows without a header, as vocabularies are kept."""
    df.write.option("sep", sep).csv(path)


def markdown_lines(df: DataFrame, order: str) -> DataFrame:
    """place and line of a Markdown table: the header, the rule under it, and a row for each of df in order (place, line), cells with their bars escaped."""
    names = [c for c in df.columns if c != order]
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit(r"\|"))
    bar = lambda xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(-2, f"| {' | '.join(names)} |"), (-1, f"|{'---|' * len(names)}")], "place long, line string")
    return head.unionByName(df.select(F.col(order).cast("long").alias("place"), bar([cell(c) for c in names]).alias("line")))


def sitemap_rows(sitemaps: DataFrame) -> DataFrame:
    """kind (sitemapindex or urlset), loc and lastmod of the entries of sitemaps (url, body: bytes, gzip or not); what can't be read has none."""
    import gzip
    import zlib
    from xml.etree import ElementTree

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = lambda e: e.tag.rpartition("}")[2]
        for pdf in batches:
            rows = []
            for url, body in zip(pdf["url"], pdf["body"], strict=True):
                try:
                    root = ElementTree.fromstring(gzip.decompress(body) if bytes(body[:2]) == b"\x1f\x8b" else bytes(body))
                except (ElementTree.ParseError, OSError, EOFError, zlib.error, TypeError):
                    continue
                for entry in root:
                    found = {local(e): (e.text or "").strip() for e in entry}
                    if found.get("loc"):
                        rows.append((url, local(root), found["loc"], found.get("lastmod", "")))
            yield pd.DataFrame(rows, columns=["url", "kind", "loc", "lastmod"])

    return sitemaps.mapInPandas(read, "url string, kind string, loc string, lastmod string")


def expanded_sitemaps(seeds: DataFrame, sitemaps: DataFrame, depth: int = 8) -> DataFrame:
    """The distinct loc and lastmod of the pages that seeds (url) reach over sitemaps (url, body) held in a table; an index is followed once. Deeper than depth raises."""
    spark = seeds.sparkSession

    def cut(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    rows = cut(sitemap_rows(sitemaps), "sitemap-rows")
    edges = rows.filter("kind = 'sitemapindex'").select("url", "loc").distinct()
    seen = front = cut(seeds.select("url").distinct(), "sitemaps")
    for _ in range(depth):
        front = cut(edges.join(front, "url").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"), "sitemaps")
        if front.isEmpty():
            return rows.filter("kind = 'urlset'").join(seen, "url", "left_semi").select("loc", "lastmod").distinct()
        seen = seen.unionByName(front)
    raise ValueError(f"sitemaps more than {depth} deep")


def offerings(rows: DataFrame, period: str, location: str = "", mode: str = "") -> DataFrame:
    """Rows (href, cells: of a table's row) of the offerings of a period (a pattern), place and mode (whole, in any case; empty is any): offering_id, location, mode."""
    cell = lambda i: F.trim(F.regexp_replace(F.get("cells", F.lit(i)), r"\s+", " "))
    same = lambda i, v: F.lower(cell(i)) == v.lower() if v else F.lit(True)
    ok = F.contains("href", F.lit("/course-profiles/")) & (F.size("cells") >= 3) & cell(0).rlike(period) & same(1, location) & same(2, mode)
    return rows.filter(ok).select(F.regexp_extract(F.rtrim("href", F.lit("/")), "([^/]+)$", 1).alias("offering_id"), cell(1).alias("location"), cell(2).alias("mode"))


class _Tree(HTMLParser):
    """The text blocks of a page in order, each with its tag, and its tables as rows of cells."""

    BLOCKS = {"h1", "h2", "h3", "h4", "p", "dt", "dd", "li", "th", "td", "label", "div", "span"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list[str]] = []
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []
        if tag in self.BLOCKS:
            self.blocks.append([tag, ""])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        if tag in self.BLOCKS:
            self.blocks.append(["", ""])

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)
        if not self.blocks:
            self.blocks.append(["", ""])
        self.blocks[-1][1] += data


COURSE = (
    "code string, title string, fields map<string, string>, incompatible array<string>, prerequisite string, "
    "assessments array<struct<task: string, category: string, weight: double, hurdle: boolean>>, activities array<struct<period: string, activity_type: string, topic: string, learning_outcomes: array<string>>>"
)
#: The labels of a course page, and words of its tables.
LABELS = ["Study period", "Location", "Attendance mode", "Study level", "Units", "Coordinating unit"]


def read_course(html: str | None, offering_id: str) -> dict:
    """The blocks and tables of a course page as fields; what the page lacks is null or empty."""
    page = _Tree()
    page.feed(html or "")
    page.close()
    blocks = [(tag, " ".join(x.split())) for tag, x in page.blocks if x.strip()]
    head = next((x for tag, x in blocks if tag == "h1"), "")
    named = re.search(r"\(([A-Z]{2,4}\d{4})\)", head)
    after = lambda i: next((x for _, x in blocks[i + 1 : i + 2]), None)
    fields = {}
    for label in LABELS:
        at = next((i for i, (_, x) in enumerate(blocks) if x.rstrip(":").lower() == label.lower()), None)
        if at is not None and after(at):
            fields[label] = after(at)
    section = lambda pattern: next((i for i, (_, x) in enumerate(blocks) if re.fullmatch(pattern, x, re.I)), None)
    paragraphs = lambda i: [x for tag, x in blocks[i + 1 :] if tag == "p"][:4] if i is not None else []
    codes = next((c for x in paragraphs(section("Incompatible")) if (c := re.findall(r"[A-Z]{2,4}\d{4}", x))), [])
    said = [re.sub(r"^You'?ll need to complete.*?:\s*", "", x, flags=re.I).strip() for x in paragraphs(section("Prerequisites?"))]
    said = [x for x in said if x]
    prerequisite = next((x for x in said if re.search(r"[A-Z]{2,4}\d{4}", x)), said[0] if said else "")
    table = lambda *words: next((t[1:] for t in page.tables if t and all(w in " ".join(t[0]) for w in words)), [])
    assessments = []
    for cells in table("Assessment task", "Weight"):
        if len(cells) >= 3:
            weight = re.search(r"(\d+(?:\.\d+)?)\s*%", cells[2])
            task = re.sub(r"(Hurdle|Identity Verified|In-person)", "", cells[1]).strip()
            assessments.append({"task": task, "category": cells[0], "weight": float(weight[1]) if weight else None, "hurdle": "hurdle" in cells[1].lower()})
    activities = []
    for cells in table("Topic", "Activity type"):
        if cells:
            period, activity, topic = cells[:3] if len(cells) >= 3 else ["", *cells] if len(cells) == 2 else ["", "", cells[0]]
            topic, *outcomes = re.split(r"Learning outcomes\s*:?", topic, flags=re.I)
            topic = re.sub(r"^\s*Week\s*\d+\s*", "", topic)
            topic = re.sub(rf"^\s*{re.escape(activity)}s?\b\s*", "", topic, flags=re.I) if activity else topic
            activities.append({"period": period, "activity_type": activity, "topic": topic.strip(" ."), "learning_outcomes": re.findall(r"L0?\d+", outcomes[0]) if outcomes else []})
    return {
        "code": named[1] if named else offering_id.split("-")[0], "title": re.sub(r"\s*\([A-Z]{2,4}\d{4}\)\s*$", "", head).strip(), "fields": fields, "incompatible": codes,
        "prerequisite": prerequisite, "assessments": assessments, "activities": activities,
    }


def course_pages(pages: DataFrame, id_column: str, html: str = "html") -> DataFrame:
    """pages' id as offering_id, and course (COURSE): fields by their labels, tables of assessments and activities, a row a page."""

    def read(ids: pd.Series, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_course(x, i) for i, x in zip(ids, values, strict=True)], columns=[x.split()[0] for x in ("code", "title", "fields", "incompatible", "prerequisite", "assessments", "activities")])

    return pages.select(F.col(id_column).cast("string").alias("offering_id"), F.pandas_udf(read, COURSE)(F.col(id_column).cast("string"), F.col(html)).alias("course"))
