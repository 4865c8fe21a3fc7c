"""Spark-native analysis of recorded AI-agent runs.

Interval events, counters, causal edges and attributes of many recorded
sessions are held as Spark tables; the library declares the analysis of them
as DataFrame plans.  Start with :class:`spanloom.plans.trace.AgentTrace`.
"""

__version__ = "0.1.0"
