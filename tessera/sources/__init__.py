"""Where change sets come from: git ranges, unified diffs, content pairs."""
