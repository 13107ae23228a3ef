"""Item metadata: sidecar text, fallbacks, legacy rows and what to display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from airlog.functions.values import col, let

# Fixed value: at most this many lines of a plain-text sidecar are kept.
MAX_LINES = 5

_FIELDS = ("title", "artist", "album", "year", "premiered", "genre", "plot", "outline", "showtitle", "season",
           "episode", "aired")
_XML = T.StructType([T.StructField(name, T.StringType()) for name in _FIELDS])
# Root tag of a sidecar -> type of the metadata.
ROOT_TYPES = {"musicvideo": "music", "movie": "movie", "episodedetails": "episode", "tvshow": "tvshow"}


def _text(value: Column) -> Column:
    return F.nullif(F.regexp_replace(value, r"(?U)\A\s+|\s+\z", ""), F.lit(""))


def root_tag(text: Column | str) -> Column:
    """Name of the XML root element, null for text that does not look like XML."""
    body = F.regexp_replace(col(text), r"(?s)\A\s*(<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*", "")
    return F.nullif(F.regexp_extract(body, r"\A<([A-Za-z_][\w.\-]*)[\s/>]", 1), F.lit(""))


def parse_sidecar(text: Column | str) -> Column:
    """Metadata struct of one sidecar: XML with any root tag, else up to five plain lines."""
    raw = col(text)
    xml = F.from_xml(raw, _XML, {"mode": "PERMISSIVE"})
    return let(F.struct(raw.alias("raw"), root_tag(raw).alias("tag"), xml.alias("xml")), _from_parsed)


def _from_parsed(p: Column) -> Column:
    raw, tag, xml = p["raw"], p["tag"], p["xml"]
    closed = F.regexp_like(raw, F.concat(F.lit(r"(?s)(</"), tag, F.lit(r"\s*>|/>)\s*\z")))
    is_xml = F.coalesce(tag.isNotNull() & closed, F.lit(False))

    def field(name: str) -> Column:
        return _text(xml[name])

    known = F.create_map(*[F.lit(x) for pair in ROOT_TYPES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(known, tag), tag)
    music, movie, show = kind == "music", kind == "movie", kind == "tvshow"
    episode = kind == "episode"
    generic = ~kind.isin(*ROOT_TYPES.values())
    year = F.coalesce(field("year"), F.nullif(F.substring(field("premiered"), 1, 4), F.lit("")))
    plot = F.coalesce(field("plot"), field("outline"))

    def digits(name: str) -> Column:
        return F.when(F.regexp_like(field(name), F.lit(r"\A[0-9]+\z")), field(name).try_cast("int"))

    lines = F.slice(
        F.filter(F.transform(F.split(raw, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), _text),
                 lambda x: x.isNotNull()), 1, MAX_LINES)
    from_xml = F.struct(
        kind.alias("type"),
        field("title").alias("title"),
        F.when(music, field("artist")).alias("artist"),
        F.when(music, field("album")).alias("album"),
        F.when(music | movie | show, year).when(generic, field("year")).alias("year"),
        F.when(music | movie | show | generic, field("genre")).alias("genre"),
        F.when(movie | show | episode, plot).when(generic, field("plot")).alias("plot"),
        F.when(episode, field("showtitle")).alias("show_title"),
        F.when(episode, field("season")).alias("season_raw"),
        F.when(episode, digits("season")).alias("season"),
        F.when(episode, field("episode")).alias("episode_raw"),
        F.when(episode, digits("episode")).alias("episode"),
        F.when(episode, field("aired")).alias("aired"),
        F.lit(None).cast("array<string>").alias("lines"),
    )
    null = F.lit(None)
    plain = F.struct(
        F.lit("plaintext").alias("type"),
        F.element_at(lines, 1).alias("title"),
        *[null.cast("string").alias(n) for n in ("artist", "album", "year", "genre", "plot", "show_title", "season_raw")],
        null.cast("int").alias("season"),
        null.cast("string").alias("episode_raw"),
        null.cast("int").alias("episode"),
        null.cast("string").alias("aired"),
        lines.alias("lines"),
    )
    usable = F.when(generic, field("title").isNotNull()).otherwise(F.coalesce(
        *[field(n) for n in _FIELDS if n not in ("premiered", "outline")], year, plot).isNotNull())
    return F.when(is_xml, F.when(usable, from_xml)).when(F.size(lines) > 0, plain)


def normalize_meta(meta: Column | str) -> Column:
    """Bring an older metadata struct up to date: `date` becomes the year, the type defaults to music.

    The input struct has at least type, title, year and date fields; other fields are kept.
    """
    m = col(meta)
    return m.dropFields("date").withField("year", F.coalesce(m["year"], m["date"])).withField(
        "type", F.coalesce(m["type"], F.lit("music")))


def meta_fallbacks(meta: Column | str) -> Column:
    """Year from the premiere date and plot from the outline where the main field is empty."""
    m = col(meta)
    blank = F.lit("")
    year = F.coalesce(F.nullif(m["year"], blank), F.nullif(F.substring(m["premiered"], 1, 4), blank))
    plot = F.coalesce(F.nullif(m["plot"], blank), F.nullif(m["outline"], blank))
    return m.dropFields("premiered", "outline").withField("year", year).withField("plot", plot)


def display_fields(meta: Column | str) -> Column:
    """Title, info and description shown for an item, by its metadata type."""
    m = col(meta)
    kind, lines = m["type"], m["lines"]
    blank = F.lit("")

    def line(n: int) -> Column:
        return F.when(F.size(lines) >= n, F.get(lines, F.lit(n - 1)))

    title = F.coalesce(F.nullif(m["title"], blank), F.when(kind == "plaintext", line(1)), blank)
    info = (
        F.when(kind == "music", m["artist"]).when(kind == "episode", m["show_title"])
        .when(kind == "plaintext", line(2)).otherwise(m["year"])
    )
    description = F.when(kind == "music", m["album"]).when(kind == "plaintext", line(3)).otherwise(m["plot"])
    return F.when(m.isNotNull(), F.struct(
        title.alias("title"),
        F.coalesce(info, blank).alias("info"),
        F.coalesce(description, blank).alias("description"),
    ))


def overlay_lines(meta: Column | str) -> Column:
    """Up to five lines laid over a music video or a plain-text item; null for other types."""
    m = col(meta)
    music = F.array(m["artist"], m["title"], m["album"], m["year"])
    picked = F.when(m["type"] == "music", music).when(m["type"] == "plaintext", m["lines"])
    lines = F.slice(F.filter(picked, lambda x: x.isNotNull() & (x != "")), 1, MAX_LINES)
    return F.when(F.size(lines) > 0, lines)
