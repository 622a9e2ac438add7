"""No streaming operators.

The reference has no watermark, event-time window, trigger, state or late
data; every corpus operator is a batch DataFrame function.  All of them are
also valid inside ``foreachBatch`` of a Structured Streaming query, which is
the supported way to run them incrementally.
"""
