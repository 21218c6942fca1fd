"""quarrymill.sources"""
