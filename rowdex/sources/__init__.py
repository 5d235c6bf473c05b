"""Where rows come from: source resolution, footers, the row-group reader, transport."""
