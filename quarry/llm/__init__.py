"""Operators for building training data at scale, one module per operator.

Nothing else in the library imports this subpackage. ``registry.py`` names the
queries and their DuckDB SQL; ``__spark_entry__.py`` adds them when this
package can be imported.
"""
