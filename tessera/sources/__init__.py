"""Where rows come from and go to: the catalog of projects, datasets and tables, CSV and inserted rows."""
