"""Named queries over the test tables, and equivalent SQL."""
