"""Incremental (Structured Streaming) forms of the batch jobs.

The reference runs its jobs as scheduled batches.  The Spark-native way to
run them on newly arriving date partitions is a streaming query over the
file source with ``trigger(availableNow=True)``: each run processes only the
new files, keeps its progress in a checkpoint under the shared folder, and
emits a period once the watermark says no more events can arrive for it.
"""

from cadence.streaming.incremental import active_users_stream, run_available_now, session_metrics_stream

__all__ = ["active_users_stream", "run_available_now", "session_metrics_stream"]
