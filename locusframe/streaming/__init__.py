"""No streaming operators.

The toolkit this package follows has no stream, watermark or state semantics,
so none are offered here.  Every source is a bounded batch scan.
"""
