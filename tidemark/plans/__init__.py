"""Named queries; each module holds QUERIES: name -> (function, SQL or None)."""
