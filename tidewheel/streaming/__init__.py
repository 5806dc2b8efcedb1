"""The sequential operators on live streams: the same kernels, buffers and matchers, kept in Spark's state store."""

from .processors import configure, stream_matches, stream_series, stream_session_sum, stream_tumbling_sum

__all__ = ["configure", "stream_matches", "stream_series", "stream_session_sum", "stream_tumbling_sum"]
