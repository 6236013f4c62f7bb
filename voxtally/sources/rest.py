"""Comment threads, replies and video metadata of a REST API: errors, retries, paging, and a Spark data source over them.

The transport is injected: a callable (url, params, timeout) that returns status and parsed body, or raises Timeout or
ConnectionError of the standard library. Paging follows tokens and so is sequential for one video; videos are read in
parallel, one partition for each.
"""

from __future__ import annotations

import json
import logging
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

logger = logging.getLogger(__name__)

Transport = Callable[[str, dict, float], tuple[int, object]]

#: Addresses, limits and reasons of the public API (fixed values).
BASE = "https://www.googleapis.com/youtube/v3"
RESOURCES = {"comments": "commentThreads", "replies": "comments", "videos": "videos"}
TIMEOUT_S, ATTEMPTS, BACKOFF_S = 30, 3, 1
RETRIED = frozenset({500, 502, 503, 504})
RATE_REASONS = frozenset({"rateLimitExceeded", "userRateLimitExceeded"})


class ApiError(Exception):
    message = "API request failed"

    def __init__(self, resource_id: str | None = None, status: int | None = None, reason: str | None = None, message: str | None = None):
        super().__init__(message or self.message)
        self.resource_id, self.status, self.reason = resource_id, status, reason


class RateLimited(ApiError):
    message = "API rate limit exceeded"


class QuotaExceeded(ApiError):
    message = "API quota exceeded"


class CommentsDisabled(ApiError):
    message = "Comments are disabled for the requested video"


class VideoNotFound(ApiError):
    message = "The requested video was not found"


class CommentNotFound(ApiError):
    message = "The requested parent comment was not found"


class HttpError(ApiError):
    message = "API request failed with an HTTP error"


BY_REASON = {"quotaExceeded": QuotaExceeded, "commentsDisabled": CommentsDisabled, "videoNotFound": VideoNotFound, "commentNotFound": CommentNotFound}


def reason_of(body: object) -> str | None:
    """The reason of the first error in a response, if the response has the form of one."""
    try:
        reason = body["error"]["errors"][0]["reason"]  # type: ignore[index]
    except (TypeError, KeyError, IndexError):
        return None
    return reason if isinstance(reason, str) else None


def error_of(status: int, body: object, resource_id: str | None) -> ApiError:
    reason = reason_of(body)
    kind = RateLimited if status == 429 or reason in RATE_REASONS else BY_REASON.get(reason or "", HttpError)
    return kind(resource_id, status, reason)


def urllib_transport(url: str, params: dict, timeout: float) -> tuple[int, object]:
    try:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=timeout) as response:  # noqa: S310
            return response.status, json.loads(response.read())
    except urllib.error.HTTPError as e:
        try:
            return e.code, json.loads(e.read())
        except ValueError:
            return e.code, None
    except urllib.error.URLError as e:
        raise (e.reason if isinstance(e.reason, TimeoutError) else ConnectionError(str(e.reason))) from e


class Client:
    def __init__(self, key: str | None, transport: Transport = urllib_transport, sleep: Callable[[float], None] = time.sleep, base: str = BASE):
        self.key, self.transport, self.sleep, self.base = key, transport, sleep, base

    def request(self, resource: str, params: dict, resource_id: str | None) -> dict:
        """One response. Timeouts, lost connections, server errors and rate limits are tried again after 1 and 2 seconds."""
        if not self.key:
            raise ValueError("API key is not set")
        for attempt in range(ATTEMPTS):
            try:
                status, body = self.transport(f"{self.base}/{RESOURCES[resource]}", params | {"key": self.key}, TIMEOUT_S)
                if status < 400:
                    return body  # type: ignore[return-value]
                error: Exception = error_of(status, body, resource_id)
                again = isinstance(error, RateLimited) or (type(error) is HttpError and status in RETRIED)
            except (TimeoutError, ConnectionError) as e:
                error, again = e, True
            if not again or attempt == ATTEMPTS - 1:
                raise error
            logger.warning("%s %s failed with %s, attempt %s of %s", resource, resource_id, type(error).__name__, attempt + 1, ATTEMPTS)
            self.sleep(BACKOFF_S * 2**attempt)
        raise AssertionError("unreachable")

    def comments(self, video_id: str, max_results: int = 10, page_token: str | None = None) -> dict:
        return self._page("comments", {"videoId": video_id}, video_id, max_results, page_token)

    def replies(self, parent_id: str, max_results: int = 100, page_token: str | None = None) -> dict:
        return self._page("replies", {"parentId": parent_id}, parent_id, max_results, page_token)

    def video(self, video_id: str) -> dict:
        return self.request("videos", {"part": "snippet,statistics", "id": video_id}, video_id)

    def _page(self, resource: str, who: dict, own: str, max_results: int, page_token: str | None) -> dict:
        params = {"part": "snippet", **who, "maxResults": max_results, "textFormat": "plainText"}
        return self.request(resource, params | ({"pageToken": page_token} if page_token else {}), own)


def pages(fetch: Callable[..., dict], own: str, max_pages: int, page_size: int) -> Iterator[tuple[int, dict]]:
    """Numbered pages until one has no next token, `max_pages` at most."""
    token = None
    for number in range(1, max_pages + 1):
        page = fetch(own, max_results=page_size, page_token=token)
        logger.info("page %s of %s: %s items", number, own, len(page["items"]))
        yield number, page
        token = page.get("nextPageToken")
        if not token:
            return


class _Item(InputPartition):
    def __init__(self, own: str):
        self.own = own


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Item(x.strip()) for x in self.options["ids"].split(",") if x.strip()]

    def read(self, partition: _Item) -> Iterator[tuple]:
        import importlib

        o = self.options
        module, _, name = o.get("client", "").partition(":")
        client = getattr(importlib.import_module(module), name)(o) if module else Client(o.get("key"))
        resource = o.get("resource", "comments")
        if resource == "videos":
            yield resource, partition.own, 1, o.get("ingested_at", ""), json.dumps(client.video(partition.own), ensure_ascii=False)
            return
        fetch = client.replies if resource == "replies" else client.comments
        for number, page in pages(fetch, partition.own, int(o.get("max_pages", 2)), int(o.get("page_size", 100 if resource == "replies" else 10))):
            yield resource, partition.own, number, o.get("ingested_at", ""), json.dumps(page, ensure_ascii=False)


class ApiPages(DataSource):
    """spark.read.format("api_pages").option("ids", "a,b").option("resource", "comments" | "replies" | "videos").load(): a
    partition for each id, a row for each page. Option client names a factory "module:function" for another client."""

    @classmethod
    def name(cls) -> str:
        return "api_pages"

    def schema(self) -> str:
        return "resource string, id string, page_number int, ingested_at string, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))
