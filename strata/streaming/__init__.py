from strata.streaming.weekly import attendance_stream, stream_weekly_trend

__all__ = ["attendance_stream", "stream_weekly_trend"]
