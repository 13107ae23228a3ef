"""Path predicates by whole components, media kinds and stable media identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from airlog.functions.values import col

# File extensions by kind.
VIDEO_FORMATS = ("mp4", "mpg", "mpeg", "avi", "mov", "mkv", "ts", "m4v", "webm", "wmv")
AUDIO_FORMATS = ("mp3", "m4a", "flac", "wav", "aac", "ogg", "opus", "wma")

# Words and shapes that must not appear in published text.
POSIX_PATH = r"""(?:^|[\s"'=:(])/(?:[^/\s]+(?:/|\z))"""
WINDOWS_PATH = r"""(?:^|[\s"'=:(])(?:[A-Za-z]:[\\/]|\\\\)"""
SECRET_WORDS = (
    r"(?i)(authorization|bearer|cookie|password|passwd|private[ _-]?key|api[ _-]?key|"
    r"access[ _-]?token|refresh[ _-]?token|secret|environment(?: variables?)?)"
)


def parts(path: Column | str) -> Column:
    """Path components; an absolute path starts with the component '/'."""
    text = col(path)
    named = F.filter(F.split(text, "/"), lambda p: (p != "") & (p != "."))
    return F.when(F.startswith(text, F.lit("/")), F.concat(F.array(F.lit("/")), named)).otherwise(named)


def _starts(whole: Column, head: Column) -> Column:
    return (F.size(whole) >= F.size(head)) & (F.slice(whole, F.lit(1), F.size(head)) == head)


def _parent(path: Column | str) -> Column:
    p = parts(path)
    return F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))


def is_under(directory: Column | str, path: Column | str) -> Column:
    """Whether a path is the directory or lies below it."""
    return _starts(parts(path), parts(directory))


def ends_with_dir(path: Column | str, relative: Column | str) -> Column:
    """Whether the directories of a file end with the given relative directories."""
    folders, tail = _parent(path), parts(relative)
    n = F.size(tail)
    matched = F.slice(folders, F.greatest(F.size(folders) - n + 1, F.lit(1)), n) == tail
    return F.when(n > 0, (F.size(folders) >= n) & matched).otherwise(F.size(folders) == 0)


def dir_from_base(path: Column | str, base: Column | str) -> Column:
    """Directory components of a file below a base directory; null when it is elsewhere."""
    folders, head = _parent(path), parts(base)
    return F.when(_starts(folders, head), F.slice(folders, F.size(head) + 1, F.size(folders)))


def first_match(path: Column | str, base: Column | str, patterns: Sequence[str]) -> Column:
    """First pattern whose components begin the file's directory below the base."""
    below = dir_from_base(path, base)
    hits = [F.when(_starts(below, parts(F.lit(p))), F.lit(p)) for p in patterns]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def extension(path: Column | str) -> Column:
    """Lower-case extension without its dot, '' when there is none."""
    return F.lower(F.regexp_extract(col(path), r"[^/.][^/]*\.([^./]*)\z", 1))


def media_type(path: Column | str) -> Column:
    return F.when(extension(path).isin(*AUDIO_FORMATS), "audio").otherwise("video")


def show_dir(path: Column | str) -> Column:
    """Directory of a file without trailing season folders; null when nothing is left."""
    folder = F.regexp_replace(col(path), r"/?[^/]*\z", "")
    return F.nullif(F.regexp_replace(folder, r"(?i)(?:(?:\A|/)(?:season\s*\d+|s\d+))+\z", ""), F.lit(""))


def show_of(path: Column | str) -> Column:
    """First path component, or '(media root)' for a file at the top."""
    p = F.split(col(path), "/")
    return F.when(F.size(p) > 1, F.get(p, F.lit(0))).otherwise("(media root)")


def unsafe_text(text: Column | str, scheme: str = "media:/") -> Column:
    """What makes a text unsafe to publish: posix_path, windows_path or secret; null when safe.

    A logical identity (scheme followed by a path) is not an absolute path.
    """
    scrubbed = F.replace(col(text), F.lit(scheme), F.lit(scheme.rstrip("/")))
    return (
        F.when(F.regexp_like(scrubbed, F.lit(POSIX_PATH)), "posix_path")
        .when(F.regexp_like(scrubbed, F.lit(WINDOWS_PATH)), "windows_path")
        .when(F.regexp_like(scrubbed, F.lit(SECRET_WORDS)), "secret")
    )


def media_identity(path: Column | str, roots: Sequence[str], scheme: str = "media:/") -> Column:
    """Struct of a logical identity that is the same under every known root, and an error.

    The first root holding the path is cut off. Traversal, control characters, backslashes and
    paths under no root give an error and no identity.
    """
    text = col(path)
    relative = F.lit(None).cast("string")
    for root in reversed([r.rstrip("/") for r in roots]):
        inside = (text == root) | F.startswith(text, F.lit(root + "/"))
        cut = F.regexp_replace(F.substr(text, F.lit(len(root) + 1)), r"\A/+|/+\z", "")
        relative = F.when(inside, F.regexp_replace(cut, "/+", "/")).otherwise(relative)
    error = (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(F.regexp_like(text, F.lit(r"[\x00-\x1f\\]")), "unsafe_character")
        .when(F.exists(F.split(text, "/"), lambda p: p == ".."), "traversal")
        .when(relative.isNull(), "outside_roots")
    )
    return F.struct(
        F.when(error.isNull(), F.concat(F.lit(scheme), relative)).alias("identity"), error.alias("error"))
