"""Response-quality drift analytics as Spark jobs.

Raw provider payloads become a response table; requests and responses are
embedded, grouped into topics with mergeable clustering features, scored
against a capped golden set per topic, and watched for falling scores.
"""

from topicgauge.params import Params

__all__ = ["Params"]
