"""fleetlens: Spark jobs over cluster-operations data.

Metrics payloads, time-series panels, layered configuration documents and
fleet inventory, all as ``DataFrame -> DataFrame`` functions.
"""
