"""Scalar expressions on paths, ids, urls and text; all of them stay in the JVM."""
