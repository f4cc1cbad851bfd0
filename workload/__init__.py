"""The operators applied to the provided tables: views, queries and their reference SQL."""
