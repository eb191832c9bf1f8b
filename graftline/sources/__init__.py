"""graftline.sources"""
