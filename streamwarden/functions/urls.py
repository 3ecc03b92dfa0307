"""Container and stream URL forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let


def _col(url) -> Column:
    return F.col(url) if isinstance(url, str) else url


def _without_last(url: Column, n: int) -> Column:
    parts = F.split(url, "/", -1)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - n, F.lit(0))), "/")


def sibling_bucket_url(container, ts_ms: Column) -> Column:
    """Bucket next to ``container``: its last segment becomes the timestamp."""
    return F.concat(_without_last(_col(container), 2), F.lit("/"), ts_ms.cast("string"), F.lit("/"))


def child_bucket_url(container, ts_ms: Column) -> Column:
    """Bucket below ``container``; 'none' when the result is not an http URL."""
    url = F.concat(_without_last(_col(container), 1), F.lit("/"), ts_ms.cast("string"), F.lit("/"))
    return F.when(F.contains(url, F.lit("http")), url).otherwise(F.lit("none"))


def bucket_epoch(url) -> Column:
    """Epoch in a bucket URL (second-last part), null if it is not a number."""
    return F.try_element_at(F.split(_col(url), "/", -1), F.lit(-2)).try_cast("bigint")


def stream_of_target(target) -> Column:
    """Stream a notification belongs to: a trailing ``/<digits>/`` is dropped."""
    return F.regexp_replace(_col(target), r"/\d+/$", "/")


def derived_target(target) -> Column:
    """``derived`` put before the last path segment; empty segments are dropped."""
    # Origin, path and rest in one pass; a URL holds no line break.
    parts = F.split(F.regexp_replace(
        _col(target), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(.*)$", "$1\n$2\n$3"), "\n", -1)

    def moved(url: Column, segments: Column) -> Column:
        n = F.size(segments)
        head = F.slice(segments, F.lit(1), F.greatest(n - 1, F.lit(0)))
        path = F.array_join(F.concat(head, F.array(F.lit("derived")), F.slice(segments, n, F.lit(1))), "/")
        return F.when(n > 0, F.concat(url[0], F.lit("/"), path, F.get(url, F.lit(2))))

    return let(parts, lambda url: let(
        F.filter(F.split(F.get(url, F.lit(1)), "/", -1), lambda x: x != ""), lambda segments: moved(url, segments)))


def derived_resource(url) -> Column:
    """Same idea for a stream URL: only one trailing slash is dropped."""
    return F.regexp_replace(F.regexp_replace(_col(url), "/$", ""), "/([^/]*)$", "/derived/$1")


def owner_profile(stream, optional_slash: bool = True) -> Column:
    """Profile of the stream's owner; the strict form needs the URL to have no trailing slash."""
    pattern = r"/[^/]+/?$" if optional_slash else r"/[^/]+$"
    return F.regexp_replace(_col(stream), pattern, "/profile/card#me")


def server_root(url) -> Column:
    return F.concat_ws("/", F.slice(F.split(_col(url), "/", -1), 1, 3))


def container_meta(resource) -> Column:
    """Description document of the container that holds ``resource``."""
    return F.concat(_without_last(_col(resource), 1), F.lit("/.meta"))
