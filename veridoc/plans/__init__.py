"""Registered queries: each a function of (spark, sf_dir), with the SQL that checks it."""
