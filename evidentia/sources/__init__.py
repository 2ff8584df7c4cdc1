"""Where data comes from and goes to: schemas, stored tables, HTML pages, files."""
