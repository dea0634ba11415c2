"""Vibration-signal analytics on PySpark DataFrames.

Sub-packages: ``sources`` (stores, traces, buffers), ``operators`` (detection, cropping, filters, spectra,
curation, models, alarm store), ``functions`` (statistical features), ``streaming`` (keyed state) and ``plans``
(bindings to the shared tables, registered queries and their check SQL).
"""

__version__ = "0.1.0"
