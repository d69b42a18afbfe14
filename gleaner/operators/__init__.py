"""Relational operators: index, search, dedup, robots, frontier and crawl."""
