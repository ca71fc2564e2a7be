"""Product-page facts as Spark jobs: identifiers, page snapshots and fetch logs in, three tables out."""
