"""supplyscope: supplier scorecards, trends and delivery-risk models as Spark jobs.

Modules
-------
``session``            session builder and the shared checkpoint location
``schemas``            explicit input schemas
``functions.exprs``    Column helpers (dates, guarded ratios, clip, rounding, text)
``sources``            readers (CSV inputs, stand-in views on the driver tables) and sinks
``operators``          per-vendor metrics, scorecard, directory queries, sampling
``plans``              end-to-end ETL, model training and bulk order scoring
"""

__version__ = "0.1.0"
