"""End-to-end jobs: ETL (scorecard and result tables), model training, bulk order scoring."""
