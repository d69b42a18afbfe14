"""Where rows come from and go to: stores, fetchers, settings."""
